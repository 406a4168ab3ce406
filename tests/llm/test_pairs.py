"""N-gram join and embedding dedup against brute force over all pairs."""

import random

import numpy as np
import pytest

from ledgernet.llm.components import components
from ledgernet.llm.embedding_dedup import embedding_dedup
from ledgernet.llm.ngram_join import ngram_join


def classes(ids, linked):
    """id -> (smallest reachable id, links)."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = dict.fromkeys(ids, 0)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: (find(i), n[i]) for i in ids}


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
              if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return classes(ids, linked)


def near_texts(seed, groups=25, noise=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice((1, 3, 5, 8, 60, 200)))]
        for _ in range(r.choice((1, 2, 5, 12))):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((k, " ".join(t)))
            k += r.choice((1, 2, 7))
    for _ in range(noise):
        rows.append((k, " ".join(r.choice(words) for _ in range(r.randint(1, 90)))))
        k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \n ")]


@pytest.mark.parametrize("seed,small,block", [(1, 200, 2048), (2, 3, 4)])
def test_join_is_brute_force(spark, seed, small, block):
    rows = near_texts(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in
           ngram_join(docs, small=small, block_sets=block).collect()}
    want = brute_join(rows)
    # pairs are found at random: whole recall on these rows, never a wrong link
    assert got == want


def test_join_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(260):
        t = list(base)
        t[r.randrange(120)] = f"e{k}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join(docs, small=50, block_sets=64).collect()}
    assert got == brute_join(rows)
    assert {c for c, _ in got.values()} == {0}


def test_join_edge_cases(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (4, "a b c d e f", 1), (9, "a b c d e f", 2),
         (9, "zz yy", 3), (7, "a b c d e f", 1)], "doc_id long, text string, node int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.class_id, r.n_links, r.kept)
                 for r in ngram_join(docs).collect())
    assert got[:2] == [(-1, None, 0, True)] * 2
    assert {g[0] for g in got[2:]} == {4, 7, 9}
    assert got[2][:2] == (4, 4) and got[3][:2] == (7, 4)
    assert ngram_join(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def brute_vectors(rows, cosine=0.98):
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows
            if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    linked = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                linked.append((a, b))
    return classes([i for i, _, _ in rows], linked), len(linked)


def test_embeddings_recall_and_no_wrong_link(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for g in range(60):
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 2, 4, 40], p=[.4, .3, .25, .05]))):
            rows.append((k, (base + rng.normal(size=16) * 0.08).tolist(), int(g % 3)))
            k += 1
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(k + j, v, 1) for j, v in enumerate(bad)] + [(k + 10, rows[0][1], None), (k + 11, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.component_id, r.n_links, r.kept) for r in embedding_dedup(table, block=16).collect()}
    want, n = brute_vectors(rows)
    assert set(got) == set(want)
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(v[1] for v in got.values()) >= 0.9 * 2 * n > 0
    assert all(got[i][2] == (got[i][0] == i) for i in got)
    assert embedding_dedup(table.limit(0)).count() == 0


def test_embeddings_of_the_given_table_have_full_recall(spark):
    import duckdb

    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{path}'").fetchall()
    want, n = brute_vectors(rows)
    got = embedding_dedup(spark.read.parquet(path)).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 2 * n
    assert all(r.n_links <= want[r.vec_id][1] for r in got)


def test_repeated_and_null_vector_ids(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0)],
                                  "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup(table).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]
