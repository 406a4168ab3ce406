"""Conversation trie, Merkle manifest and license scan against brute force."""

import hashlib
import random
import zlib

import pytest

from ledgernet.llm import license_scan as lic
from ledgernet.llm import merkle_manifest as mm
from ledgernet.llm import places as pl
from ledgernet.llm import prefix_trie as pt
from ledgernet.llm.registry import op11_conversation_trie, op12_merkle_manifest, op13_license_scan

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- places
def test_places_of_a_group_that_spans_ranges(spark):
    r = random.Random(3)
    rows = [("hot", r.choice([None, *range(300)]), k) for k in range(700)] + [(f"g{k % 9}", k, k) for k in range(80)]
    df = spark.createDataFrame(rows, "grp string, x int, uid long").withColumn("w", pl.F.lit(2))
    got = {(x["grp"], x["uid"]): (x["place"], x["rank"]) for x in
           pl.places(df, ["grp"], ["x", "uid"], {"place": "w", "rank": pl.F.lit(1)}).collect()}
    for g in {x[0] for x in rows}:
        some = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[g, x[2]] for x in some] == [(2 * k, k) for k in range(len(some))]


def test_copies_are_written_out_in_bounded_runs(spark):
    df = spark.createDataFrame([("a", 10, 9000), ("b", 5, 1)], "k string, place long, copies long")
    got = pl.write_out(df, "copies", "place").collect()
    assert sorted(x["place"] for x in got if x["k"] == "a") == list(range(10, 9010))
    assert [x["place"] for x in got if x["k"] == "b"] == [5]


# ------------------------------------------------------- conversation trie
def brute_trie(rows):
    """``rows``: (conv_id, turn, role, text)"""
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(WORD.findall(text)).to_bytes(4, "big")
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(c - rest, [])[:h] + own[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)

    def under(p):
        return [n for n in nodes if n[:len(p)] == p]
    out = []
    for p, members in nodes.items():
        below = under(p)
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(nodes[n]) - 1) * (len(WORD.findall(n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    sum(len(n) == len(p) + 1 for n in below), len(childless), saved, sha(ends)))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string, length int, key string"


def trie_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*x, 7, "k") for x in rows], CONV).repartition(5)
    return sorted((tuple(x) for x in pt.conversation_trie(df, **kw).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("widths", [(2, 3), (8, 16, 32)])
def test_trie_equals_brute_force(spark, widths):
    r = random.Random(5)
    rows = []
    for c in [*range(0, 63), -3, -20, 1 << 40]:
        n = r.choice([0, 1, 2, 3, 5, 8, 11])
        kind = r.randint(0, 2)
        for k in range(n):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"word {k} of {kind}" if r.random() < 0.9 else f"own {c}"))
    rows += [(41, None, None, None), (41, None, "user", ""), (41, 0, "user", "x"), (41, 0, "user", "x"), (41, 0, "b", "a"),
             (None, 0, "user", "nobody's"), (43, 5, "", "a  b\tc\x0bd"), (44, 5, "", "a  b\tc\x0bd")]
    for c in (400, 420, 440):  # long copies, and one that ends earlier
        rows += [(c, k, "user", f"long {k}") for k in range(30 if c != 440 else 29)]
    assert trie_rows(spark, rows, widths=widths) == brute_trie(rows)


def test_trie_of_a_hot_conversation_and_hot_copies(spark):
    rows = [(20, k, "user", f"t{k}") for k in range(150)]
    rows += [(1000 + 20 * k, j, "user", f"same {j}") for k in range(60) for j in range(3)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert trie_rows(spark, []) == []


# ------------------------------------------------------- Merkle manifest
def brute_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)"""
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
        return out
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])

    def way(tree, k):
        out = []
        for nodes in tree[:-1]:
            a = k // 16 * 16
            out.append(("".join(nodes[a:k]), "".join(nodes[k + 1:a + 16])))
            k //= 16
        return out
    out = []
    for i, s in enumerate(names):
        for k, (_, _, d, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            sib = way(trees[s], k) + way(top, i)
            folded = d
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
                folded = leaf((*row[:4], low))
            for a, z in sib:
                folded = sha(a + folded + z)
            root = top[-1][0]
            out.append((row[0], d, trees[s][-1][0], root, sha("".join(a + z for a, z in sib)), folded, folded == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, part int, level string"


def manifest_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], DOCS).repartition(5)
    return sorted((tuple(x) for x in mm.merkle_manifest(df, **kw).collect()), key=str)


def doc_rows(n, source, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, k, k]), source, r.choice([None, "en"]), r.choice([None, k]),
             r.choice([None, "", "Some Text Ä", f"lower {k}"])) for k in range(n)]


@pytest.mark.parametrize("block_levels", [1, 2])
def test_manifest_equals_brute_force(spark, block_levels):
    # few levels a block, so that a source is cut into many leaf partitions
    rows = doc_rows(600, "big") + doc_rows(3, None) + doc_rows(1, "") + doc_rows(1, "é") + doc_rows(17, "Z")
    rows += [(5, f"s{k}", None, 1, "A") for k in range(40)] + [(9, "big", "en", 3, "Abc")] * 40
    assert manifest_rows(spark, rows, block_levels=block_levels) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    for rows in ([], [(1, None, None, None, None)], [(15, "a", "en", 1, "X" * 200_000)], doc_rows(20, "only")):
        assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_a_partition_asks_for_no_node_that_it_can_derive():
    # 40 leaves, 16..31 held: their run is whole, its two siblings are missing
    assert list(mm.missing({0: (40, 16, 16)}, 1)) == [(0, 1, 0), (0, 1, 2)]
    # all small trees of a run of sources held: nothing within it is missing
    held = {k: (3, 0, 3) for k in range(16)}
    assert list(mm.missing(held, 33)) == [(mm.TOP, 1, 1), (mm.TOP, 1, 2)]
    one = list(mm.missing({0: (40, 17, 1)}, 1))
    assert len(one) == 15 + 2 and len(set(one)) == len(one)


# ---------------------------------------------------------- license scan
def naive_base(text):
    ws = lic.words(text or "")
    found = [(k, label) for label, phrase in lic.PHRASES.items() for k in range(len(ws))
             if ws[k:k + len(phrase.split())] == phrase.encode().split()]
    starts = [k for k, _ in found]
    return (len(ws), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def test_matching_statistics_equal_brute_force():
    r = random.Random(2)
    for _ in range(60):
        seqs = [[r.randint(0, 3) for _ in range(r.randint(2, 14))] for _ in range(r.randint(1, 5))]
        every = {tuple(s[a:z]) for s in seqs for a in range(len(s)) for z in range(a + 1, len(s) + 1)}
        auto = lic.SuffixAutomaton(seqs)
        run = [r.randint(-1, 3) for _ in range(60)]
        for k, (state, n) in enumerate(auto.match(run)):
            want = max((m for m in range(k + 2) if m == 0 or tuple(run[k + 1 - m:k + 1]) in every), default=0)
            assert n == want
            if n:
                some = tuple(run[k + 1 - n:k + 1])
                assert auto.ends[state] == {(i, at) for i, s in enumerate(seqs) for at in range(n - 1, len(s))
                                            if tuple(s[at + 1 - n:at + 1]) == some}


def test_license_scan(spark):
    r = random.Random(4)
    pool = "cc by general public license all rights reserved the of MIT licensed under a Lizenz 3 version gnu".split()
    texts = [None, "", " ...", "CC-BY cc by", "cc", "General Public License general public license", "ALL RIGHTS\nreserved",
             "cc bye", "éall rights reserved", "all rights reserved" + "é", "İ cc by", "x" * 300_000, "cc by " * 50_000]
    texts += [" ".join(r.choice(pool) for _ in range(r.randint(1, 80))) for _ in range(400)]
    plant = [(label, "some words before " + text + " and after") for label, text in lic.TEMPLATES]
    changed = lic.TEMPLATES[1][1].replace("required by applicable law", "asked")
    plant.append(("apache-2.0", changed))
    rows = list(enumerate(texts + [t for _, t in plant]))
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, labels string, spans int").repartition(3)
    got = {x["doc_id"]: x for x in lic.license_scan(df).collect()}
    for i, t in rows:
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == naive_base(t), t
        assert 0 <= x["score"] <= 1 and set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(","))
    for k, (label, _) in enumerate(plant):
        x = got[len(texts) + k]
        assert {s["label"] for s in x["spans"]} == {label} and label in x["labels"].split(","), label
    whole = got[len(texts) + len(plant) - 2]["spans"][0]
    assert (whole["first_word"], whole["share"]) == (3, 1.0) and whole["n_words"] == whole["covered"]
    part = got[len(texts) + len(plant) - 1]["spans"][0]
    assert 0.9 <= part["share"] < 1
    assert not got[0]["labels"] and got[0]["score"] == 0


def test_half_a_license_is_none(spark):
    text = " ".join(lic.TEMPLATES[2][1].split()[:20])
    df = spark.createDataFrame([(1, text), (None, "the gnu license version")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lic.license_scan(df).collect()}
    assert got[1]["labels"] == "" and 0.2 < got[1]["score"] < 0.5 and got[None]["score"] < 0.9


def test_the_queries_of_the_three(spark):
    sf = "/root/testdata/sf0.001"
    for query, n in ((op11_conversation_trie, None), (op12_merkle_manifest, 200), (op13_license_scan, 200)):
        rows = query(spark, sf).collect()
        assert rows and (n is None or len(rows) == n)
    assert spark.range(0).selectExpr("id AS doc_id", "'' AS text").transform(lic.license_scan).collect() == []
