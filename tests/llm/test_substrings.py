"""Suffix and substring dedup against brute force over all windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgernet.llm import substring_dedup as sub
from ledgernet.llm import suffix_dedup as suf


def texts(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    passages = [" ".join(r.choice(words) for _ in range(r.choice((30, 60, 90)))) for _ in range(4)]
    rows: list[tuple[int, str | None]] = [(1000, None), (1001, ""), (1002, "x"), (1003, "  \t "), (1004, "a" * 1500),
                                          (1005, "ab " * 300), (1006, "ab " * 140)]
    for k in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(r.choice(passages) if r.random() < 0.5 else
                         " ".join(r.choice(words) for _ in range(r.randint(1, 60))))
        text = r.choice((" ", "\n", " \t ")).join(parts)
        if k and r.random() < 0.3:
            text = rows[-1][1] or text
            cut = r.randrange(max(1, len(text)))
            text = text[:cut] + r.choice(("", "Q", " zz ")) + text[cut + 1:]
        rows.append((r.randrange(5000) * 2 if k % 9 else k, text))
    return rows


def brute_suffix(rows, window):
    seen = defaultdict(int)
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - window + 1):
            seen[b[p:p + window]] += 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p:p + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.insert(gone[:-2], 0, False)).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_substring(rows, window):
    least: dict = {}
    data = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in data:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("seed,window,gram,hot", [(1, 100, 25, 4096), (2, 60, 20, 4096), (3, 100, 25, 0), (4, 40, 8, 5)])
def test_suffix_dedup_is_brute_force(spark, seed, window, gram, hot):
    rows = texts(seed)
    rows += rows[:3] + [rows[20]]  # repeated rows
    got = suf.suffix_dedup(frame(spark, rows), window, gram, hot)
    found = sorted(tuple(x)[:5] for x in got.collect())
    assert found == brute_suffix(rows, window)
    assert sum(x[2] for x in found) > 0


@pytest.mark.parametrize("seed,window,gram", [(1, 20, 8), (2, 12, 4), (5, 50, 20)])
def test_substring_dedup_is_brute_force(spark, seed, window, gram):
    rows = texts(seed)
    rows += [rows[20]]
    got = sub.substring_dedup(frame(spark, rows), window, gram)
    found = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got.collect())
    assert found == brute_substring(rows, window)


def test_null_ids_empty_tables_and_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(None, text, 1, 2), (3, text, 1, 2), (5, text, 1, 2)],
                                 "doc_id long, text string, dk int, first int")
    got = {r.doc_id: r.n_removed for r in sub.substring_dedup(docs).collect()}
    assert got == {None: 0, 3: 0, 5: 80}
    assert {r.n_removed for r in suf.suffix_dedup(docs, 100, 25).collect()} == {len(text)}
    assert sub.substring_dedup(docs.limit(0)).count() == 0
    assert suf.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_order_survives_hash_collisions():
    data = np.frombuffer(b"banana$bananas$bandana$banana$", np.uint8)
    at = np.array([0, 7, 15, 23])
    left = np.zeros(4, np.int64)
    right = np.array([7, 8, 8, 7])
    s = suf.AnchorSuffixes(data, at, left, right)
    want = s.order(np.array([0, 4])).tolist()
    s.poly.__class__.span, keep = (lambda self, p, a, b: (b - a) * 0), s.poly.__class__.span
    try:  # every hash collides
        assert s.order(np.array([0, 4])).tolist() == want
    finally:
        s.poly.__class__.span = keep
    assert want == [0, 3, 1, 2]


def test_long_sequences_are_cut_without_loss():
    from ledgernet.llm import rolling

    h = rolling.mix(np.random.default_rng(0).integers(0, 50, 5000).astype(np.uint64))
    bounds = np.array([0, 4000, 5000])

    def windows(most):
        out = set()
        for seg, lo, row in rolling.segment_runs(lambda a, z: h[a:z], bounds, 30, 10, most):
            for f, c, k in zip(seg.first, seg.count, seg.key):
                out |= {(int(f + lo + x), int(k)) for x in range(c)}
        return out

    assert windows(1 << 20) == windows(700)
    assert len(windows(700)) == 3971 + 971


def test_windows_are_written_of_one_document_a_segment_that_differs(spark, monkeypatch):
    r = random.Random(8)
    passage = " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(200))
    rows = [(k, passage) for k in range(30)]
    written, write = [], sub.scratch_table

    def kept(df):
        written.append(write(df))
        return written[-1]

    monkeypatch.setattr(sub, "scratch_table", kept)

    def windows():
        return sum(len(x["w1"]) for t in written if "w1" in t.columns for x in t.select("w1").collect())

    # equal segments need no windows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in sub.substring_dedup(docs).collect()} == {k: 200 * (k > 0) for k in range(30)}
    assert windows() == 0
    # the ends of a passage in other words do, of one document each
    written.clear()
    rows += [(100, "a b c " + passage + " d e f"), (101, "g h i " + passage + " j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in sub.substring_dedup(docs).collect()}
    assert got == {k: 200 * (k > 0) for k in [*range(30), 100, 101]}
    assert 0 < windows() < 30 * 151
