"""Language ID, token files, packing, chat formatting, mixing, top-k search and
the pipeline, against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgernet.llm import chat_format as chat
from ledgernet.llm import language_id as lid
from ledgernet.llm import mixing, packing, token_output, tokens
from ledgernet.llm import topk_search as topk
from ledgernet.llm.registry import op7_language_id, vocabulary

TEXTS = [None, "", " ", "a", "#", "  \n\n x", "Hello  World\tagain\r\n", "it's we'll don't", "12 3456 7", "é à ü ñ ÉÈ",
         "a   b\n \nc", "x" * 5000, "foo bar " * 3000, "a\x0b b\x1f c  d　e",
         "<|endoftext|> <|startoftext|>", "日本語 のテキスト", "ǅ ß ΣΑΣ İ", "!!!???...", "tab\t\ttab", "end "]


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_ids_of_whole_texts(name):
    r = random.Random(1)
    texts = [t or "" for t in TEXTS]
    texts += ["".join(r.choice("ab 'sé\n\t!1. Zß") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["".join(chr(r.choice((32, 10, 0x41, 0xA0, 0x301, 0x2009, 0x3A3, 0xE9, 0x4E2D, 0x1F600, 0x1C)))
                      for _ in range(20)) for _ in range(200)]
    got = tokens.tokenizer(vocabulary(name)).encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(name, t), repr(t)


def text_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(100 - 3 * k, t, 0) for k, t in enumerate(TEXTS)] + [(7000, "again", 1), (7000, "again", 1)]
    manifest = token_output.write_tokens(text_frame(spark, rows), vocabulary("byte_bpe_50k.json"), 2, str(tmp_path / "o"),
                                         length=64)
    got = [tuple(r) for r in token_output.read_tokens(manifest).orderBy("start").collect()]
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(ids_of("byte_bpe_50k.json", t) + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    # random access to equal-length sequences: the unmasked ids in order are all ids
    parts = manifest.orderBy("part").collect()
    flat = []
    for p in parts:
        reader = token_output.open_sequences(f"{p['path']}.arrow")
        n = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        for k in range(n):
            ids, mask = token_output.sequence(reader, k)
            assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16
            flat += ids[mask].tolist()
    assert len(flat) == at
    empty = token_output.write_tokens(text_frame(spark, rows).limit(0), vocabulary("byte_bpe_50k.json"), 2,
                                      str(tmp_path / "e"))
    assert token_output.read_tokens(empty).count() == 0


def brute_place(lengths, capacity):
    def squares(gaps):
        return sum(gaps.count(h) ** 2 for h in set(gaps) if h)

    gaps, out = [], []
    for size in lengths:
        options = []
        for g in sorted({g for g in gaps if g >= size}):
            rest = list(gaps)
            rest.remove(g)
            options.append((squares([*rest, g - size]), g))
        options.append((squares([*gaps, capacity - size]), capacity))
        g = min(options)[1]
        if g != capacity:
            gaps.remove(g)
        gaps.append(g - size)
        out.append(capacity - g)
    return out, len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_placement_is_the_sum_of_squares_rule(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 20) for _ in range(120)]
    seq, offset = packing.place(np.array(lengths), 20)
    want, n = brute_place(lengths, 20)
    assert offset.tolist() == want and seq.max() + 1 == n


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("shard", [65_536, 30])
def test_packed_pieces_are_the_documents(spark, shard):
    r = random.Random(2)
    rows = [(k, t, 0) for k, t in enumerate(TEXTS)] + [(5, "a", 0), (None, "b c", 0)]
    rows += [(100 + k, " ".join(["word"] * r.randint(1, 150)), 0) for k in range(150)]
    got = packing.pack_documents(text_frame(spark, rows), vocabulary("word_bpe_49k.json"), 0, capacity=128,
                                 shard=shard).collect()
    n = check_packing(got, 128)
    total = 0
    want = []
    for i, t, _ in rows:
        ids = np.array(ids_of("word_bpe_49k.json", t) + [0], "<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), 128)):
            part = ids[a:a + 128]
            want.append((i if i is not None else -1, p, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((g["doc_id"] if g["doc_id"] is not None else -1, g["piece"], g["start"], g["length"], g["ids_crc32"])
                  for g in got) == sorted(want)
    assert n <= 1.06 * -(-total // 128) + 1
    assert packing.pack_documents(text_frame(spark, rows).limit(0), vocabulary("word_bpe_49k.json"), 0).count() == 0


def test_language_id_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = op7_language_id(spark, path).join(docs, "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert len(test) > 2000 and all(r["held_out"] == (lid.crc32_of(r["doc_id"]) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edge_cases(spark):
    rows = [(k, "the cat and the dog were there" if k % 2 else "der hund und die katze waren da",
             "en" if k % 2 else "de", 0.5) for k in range(200)]
    rows += [(300, None, "en", 0.0), (301, "", None, 0.0), (302, "12 !!", "de", 0.0), (None, "the cat and the dog were there", "en", 0.0),
             (304, "der hund " * 9000, None, 0.0), (304, "der hund " * 9000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {}
    for r in lid.language_id(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[k][0]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3
    assert got[300][0]["score"] == 0 and got[300][0]["rejected"]
    assert len(got[304]) == 2 and {r["lang_pred"] for r in got[304]} == {"de"}
    assert got[None][0]["lang_pred"] == "en" and not got[None][0]["held_out"]
    assert all(got[k][0]["lang_pred"] == ("en" if k % 2 else "de") for k in range(200))
    kept = lid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r["lang_pred"] for r in lid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lid.language_id(docs.limit(0)).count() == 0


def test_chat_round_trip_and_rewriting_templates(spark):
    r = random.Random(4)
    signs = ["~", "~~l", "<|end|>", "<|turn|>", "[INST]", "</s>", "\n", "é", "", "|", "text", "<|text|>", "~b"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<|end|>"]),
             r.choice([None, *["".join(r.choice(signs) for _ in range(r.randint(0, 8))) for _ in range(6)]]), 1)
            for c in range(12) for t in range(r.randint(1, 6))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}", 1) for t in range(200)]  # longer than the context
    rows += [(None, 0, "assistant", "x", 1), (60, None, "user", "first", 1), (60, 1, "assistant", "second", 1),
             (61, 1, "user", "same", 1), (61, 1, "user", "same", 1)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {x["conv_id"]: x for x in chat.read_back(chat.chat_format(conv)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role, text))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(x or "", y or "") for _, x, y in sorted(turns, key=lambda v: (v[0], v[1] or "", v[2] or ""))]
        loss = "".join(y for x, y in turns if x == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and not g["rewritten"]
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{y}\n" for x, y in turns).encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == len(chat.turn_template([{"role": x, "text": y} for x, y in turns]))

    def last_only(turns):
        return "".join(t["text"] if k == len(turns) - 1 else "..." for k, t in enumerate(turns))
    marks = [x["rewritten"] for x in chat.chat_format(conv.where("conv_id = 50"), last_only).collect()]
    assert sum(marks) == 199
    assert chat.read_back(chat.chat_format(conv.limit(0))).count() == 0
    # a text that begins like what follows it is still found
    piece, a, z, bad = chat.Renderer(lambda ts: "".join(f"{t['text']}ac" for t in ts)).push({"role": "u", "text": "ab"})
    assert (piece, piece[a:z], bad) == ("abac", "ab", False)


def test_rake_meets_the_targets(spark):
    r = random.Random(6)
    rows = [(f"s{i}", f"l{j}", f"t{k}", r.randint(1, 1000)) for i in range(6) for j in range(3) for k in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = {by: mixing.tempered(cells, by, 0.3) for by in mixing.MARGINALS}
    fitted = mixing.rake(cells, goals, rounds=6).toPandas()
    for by in mixing.MARGINALS:
        want = {x["value"]: x["share"] for x in goals[by].collect()}
        for v, have in fitted.groupby(by)["fitted"].sum().items():
            assert abs(have - want[v]) < 1e-4


def test_mixing_edge_cases_and_shares(spark):
    r = random.Random(7)
    rows = [(k, "big" if k % 3 else f"s{k % 5}", r.choice(["en", "de", None]), "w " * r.randint(1, 30), 1)
            for k in range(3000)]
    rows += [(9001, None, None, None, 1), (9002, "big", "en", "  ", 1), (None, "big", "en", "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, tokens int")
    got = mixing.mix(docs, temper=0.5).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert len(got) == len(rows) and got.probability.between(0, 1).all() and got.probability.max() == 1
    assert not got[got.n_tokens == 0].kept.any()
    named = got[got.n_tokens > 0]
    expected = (named.n_tokens * named.probability).groupby(named.source).sum()
    shares = (expected / expected.sum()).to_dict()
    raw = named.groupby("source").n_tokens.sum() ** 0.5
    assert all(abs(shares[s] - v) < 2e-3 for s, v in (raw / raw.sum()).items())
    sample = mixing.sample(docs, temper=0.5)
    assert sample.columns == docs.columns
    kept = {None if np.isnan(x) else int(x) for x in got[got.kept].doc_id.astype(float)}
    assert {x["doc_id"] for x in sample.collect()} == kept
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_rare_cell_does_not_thin_the_others(spark, caplog):
    r = random.Random(11)
    rows = [(k, f"s{k % 3}", r.choice(["en", "de"]), "w " * r.randint(50, 150)) for k in range(3000)]
    rows += [(9000, "new", "xx", "one two three four five"), (9001, "s0", "en", " "), (9002, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    with caplog.at_level("INFO", logger=mixing.__name__):
        got = [x["doc_id"] for x in mixing.resample(docs, temper=0.7).collect()]
    common = {i for i in got if i < 3000}
    assert len(common) > 0.9 * 3000 and got.count(9000) > 1 and not {9001, 9002} & set(got)
    assert "residual" in caplog.text
    # the budget and, where targets can be met, the shares
    few = docs.where("doc_id < 3000")
    cells = mixing.weights(mixing._names(mixing._measured(few)), 0.3).toPandas()
    assert abs((cells.weight * cells.tokens).sum() / cells.tokens.sum() - 1) < 1e-6
    for by in mixing.MARGINALS:
        raw = cells.groupby(by).tokens.sum() ** 0.3
        assert ((cells.groupby(by).fitted.sum() - raw / raw.sum()).abs() < 2e-6).all()
    out = mixing.resample(few, temper=0.3)
    assert out.columns == few.columns
    tokens = sum(len(x["text"].split()) for x in out.collect())
    assert abs(tokens / cells.tokens.sum() - 1) < 0.05
    assert mixing.resample(docs.limit(0)).count() == 0


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(k, np.round(rng.normal(size=6), 1).tolist()) for k in range(400)]  # many ties
    rows += [(500, rows[0][1]), (501, None), (502, [float("nan")] * 6), (503, [1.0, 2.0]), (600, [3.0, 4.0]),
             (0, rows[0][1]), (None, [1.0] * 6), (504, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in topk.topk_search(table, F.col("vec_id") % 50 == 0, queries=3, candidates=64, pivots=8).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v
            and np.isfinite(v).all()}
    for q in [i for i in good if i % 50 == 0]:
        want = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.topk_search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_elimination_skips_candidates():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(20, 4)) * 3000
    c = (centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 4)) * 20).astype(np.int64)
    best = [topk.Best(10)]
    n = topk.search_block(best, np.array([-1]), c[:1], np.arange(4000), c, c[:32])
    want = np.lexsort((np.arange(4000), -(c @ c[0])))[:10]
    assert best[0].ids.tolist() == want.tolist() and n < 4000


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    base = " ".join(f"the{k % 7} of{k} and in to" for k in range(30))
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(k, f"some words of document {k} " + " ".join(f"w{k}x{j}" for j in range(60)), "en", f"s{k % 3}", 1)
            for k in range(40)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s0", 1), (102, base + " tail", "en", "s1", 1),
             (103, None, "en", "s0", 1), (104, "12 34", None, "s0", 1), (105, "", "en", None, 1)]
    rows += [(200 + k, f"lead {k} a{k} b{k} c{k} {passage}\nend{k} x{k} " + " ".join(f"v{k}y{j}" for j in range(40)), "en",
              "s2", 1) for k in range(3)]
    rows += [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in one.collect()} == {r[0] for r in rows} - {103, 104, 105}
    two = cp.drop_near_duplicates(spark, one, "")
    assert two.columns == docs.columns
    assert sorted(r["doc_id"] for r in two.collect()) == [*range(40), 100, 200, 201, 202]
    three = {r["doc_id"]: r for r in cp.remove_repeated_passages(spark, two, "").collect()}
    assert three[200]["text"] == rows[46][1] and len(three) == 44
    assert "shared5" not in three[201]["text"] and three[201]["text"].startswith("lead 1 a1 b1 c1 end1 x1")
    assert three[201]["n_chars"] == len(three[201]["text"])
    four = cp.mix_sources(spark, two, "")
    assert four.columns == docs.columns and 0 < four.count() <= 44
    assert check_packing(cp.pack_sequences(spark, four, "").collect(), 2048) >= 1
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]


def test_mixing_and_passages_with_clashing_columns(spark):
    import corpus_pipeline as cp

    passage = " ".join(f"shared{k}" for k in range(60))
    rows = [(k, f"lead {k} {passage} " + " ".join(f"v{k}y{j}" for j in range(40)), "en", f"s{k % 2}", 1) for k in range(6)]
    rows += [(None, None, None, None, None), (9, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["__kept", "__p", "__id", "__dk", "__n", "__copy", "__topic", "__tokens", "__source", "__lang", "__row", "a.b"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")))
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for stage in (lambda d: cp.remove_repeated_passages(spark, d, ""), lambda d: cp.mix_sources(spark, d, ""), mixing.sample):
        got, want = stage(docs), stage(docs.select(*plain))
        assert got.columns == docs.columns and stage(docs.limit(0)).count() == 0
        kept = got.collect()
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for r in kept for n in names)
        assert sorted(str(tuple(r[c] for c in plain)) for r in kept) == sorted(str(tuple(r)) for r in want.collect())


def test_topk_refuses_vectors_whose_scores_leave_64_bits(spark):
    fits = spark.createDataFrame([(0, [2e6, 0.0]), (1, [2e6, 1.0]), (2, [-2e6, 0.0])], "vec_id long, embedding array<double>")
    got = topk.topk_search(fits, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == \
        [(1, 2048000000 ** 2), (2, -2048000000 ** 2)]
    for big in ([1e10, 0.0], [2.5e6, 2.5e6], [1e300, 0.0]):
        with pytest.raises(Exception, match="may not fit 64 bits"):
            topk.topk_search(fits.union(spark.createDataFrame([(3, big)], fits.schema)), F.col("vec_id") == 0).collect()
