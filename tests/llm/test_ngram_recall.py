"""Pairs at the threshold are found, also those whose sketches agree little."""

import numpy as np
import pyarrow as pa

from ledgernet.llm import ngram_join as nj


def pair(k):
    """Two texts of 90 shingles, 80 of them in common: similarity 0.8."""
    words = [f"p{k}w{j}" for j in range(94)]
    return " ".join(words), " ".join([f"p{k}x{j}" for j in range(10)] + words[10:])


def sketches(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)],
                                       names=["doc_id", "dk", "text"])
    return np.concatenate([nj._signatures(b.column("sig")) for b in nj._embed(5)(iter([batch]))])


def test_pairs_of_little_sketch_agreement_are_linked(spark):
    texts = [t for k in range(12_000) for t in pair(k)]
    sig = sketches(texts)
    agree = (sig[::2] == sig[1::2]).sum(axis=1)
    sets = [s for _, part in nj.shingle_sets(pa.array(texts[:2]), 5) for s in part]
    assert len(np.intersect1d(*sets)) / len(np.union1d(*sets)) == 0.8
    weak = np.flatnonzero(agree < 41)
    assert len(weak) >= 3
    rows = [(2 * int(k) + x, texts[2 * k + x]) for k in [*weak, *range(500)] for x in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").distinct().repartition(4)
    got = {x["doc_id"]: x["class_id"] for x in nj.ngram_join(docs).collect()}
    assert got == {i: i - i % 2 for i in got}


def test_the_stated_miss():
    assert nj.RUNS * nj.TOKENS <= nj.COORDS and nj.RUNS <= 1 << nj.RUN_BITS
    assert nj.miss(0.8) + sum(nj._binomial(nj.COORDS, 0.8)[:nj.least_agreement(0.8)]) < 1e-6
    # sketches that agree in 0.8 of the coordinates meet in a root bucket of some run
    r = np.random.default_rng(1)
    n = 4000
    a = r.integers(0, 1 << 32, (n, nj.COORDS), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    found = np.zeros(n, bool)
    paths = []
    for s in (a, b):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([x.tobytes() for x in s], pa.binary())],
                                           names=["node", "sig"])
        paths.append({(p, k) for out in nj._follow(0.8, 12, True)(iter([batch]))
                      for p, k in zip(out.column("path").to_pylist(), out.column("node").to_pylist())})
    found[[k for _, k in paths[0] & paths[1]]] = True
    assert found.all()
