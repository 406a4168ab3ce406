"""What the n-gram join moves: members of joins only, blocks of near copies compressed."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgernet.llm import ngram_join as ng


def test_only_members_drops_rows_before_the_join(spark):
    rows = spark.range(20000).select("id", F.pmod("id", F.lit(7)).alias("k"), F.lit("x").alias("text"))
    wanted = spark.range(0, 20000, 100).select("id", F.pmod("id", F.lit(7)).alias("k"))
    kept = ng.only_members(rows, ["id", "k"], wanted)
    assert kept.schema == rows.schema
    ids = {r.id for r in kept.collect()}
    assert ids >= set(range(0, 20000, 100)) and len(ids) < 2000
    assert ng.only_members(rows, ["id"], wanted.limit(0)).count() == 0


def test_blocks_of_near_copies_are_small_and_whole():
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join([f"f{f}", *words[:f], f"e{k}", *words[f:]]) for k in range(40) for f in (20, 120, 220)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5] * 120), pa.array([1] * 120), pa.array([0] * 120, pa.int32()), pa.array([1] * 120, pa.int32()),
         pa.array(range(120)), pa.array([1] * 120), pa.array(texts)],
        names=["key", "grp", "block", "n_blocks", "node", "copies", "text"])
    (row,) = [r for b in ng._pack(5)(iter([batch])) for r in b.to_pylist()]
    size = np.frombuffer(row["size"], np.int64)
    assert sorted(np.frombuffer(row["node"], np.int64)) == list(range(120))
    assert len(row["body"]) < 8 * size.sum() / 4
    side = pa.RecordBatch.from_pylist([{"pair": 9, "side": 2, **row}])
    found = {r["node"]: r["n"] for b in ng._verify(0.8)(iter([side])) for r in b.to_pylist()}
    assert found == {k: 119 for k in range(120)}


def test_sets_of_a_common_passage_leave_the_large_group(spark, monkeypatch):
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{k}_{j}" for j in range(15)] + passage + [f"b{k}_{j}" for j in range(15)])) for k in range(150)]
    rows += [(200 + k, " ".join([*passage, *[f"c{j}" for j in range(60)], f"d{k}"])) for k in range(40)]
    written, write = [], ng.scratch_table

    def kept(df):
        written.append(write(df))
        return written[-1]

    monkeypatch.setattr(ng, "scratch_table", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ng.ngram_join(docs, small=10, block_sets=16).collect()}
    assert got == {k: (k, 0) for k in range(150)} | {200 + k: (200, 39) for k in range(40)}
    blocks = [r for t in written if "body" in t.columns for r in t.collect()]
    nodes = {int(x) for r in blocks for x in np.frombuffer(r["node"], np.int64)}
    assert nodes >= set(range(200, 240)) and len(nodes) < 60
    assert sum(len(r["body"]) for r in blocks) < 30_000


def test_a_pair_of_full_blocks_is_verified_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    base = r.integers(1, 1 << 62, 300, dtype=np.uint64)
    halves = []
    for side in (0, 1):
        sets = [np.unique(np.append(base, r.integers(1, 1 << 62, 5, dtype=np.uint64))) for _ in range(2048)]
        size = np.array([len(s) for s in sets], np.int64).tobytes()
        halves.append({"pair": 9, "side": side, "node": np.arange(2048 * side, 2048 * (side + 1)).tobytes(),
                       "copies": np.ones(2048, np.int64).tobytes(), "size": size, "held": size,
                       "body": pa.compress(np.concatenate(sets), "zstd", asbytes=True)})
    batch = pa.RecordBatch.from_pylist(halves)
    tracemalloc.start()
    found = {x["node"]: (x["n"], x["root"]) for b in ng._verify(0.8)(iter([batch])) for x in b.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {k: (2048, 0) for k in range(4096)}
    assert peak < 150 << 20


def test_near_duplicates_shuffles_no_document_that_stays(spark):
    import corpus_pipeline

    rows = [(k, f"s{k}", " ".join(f"w{k}_{j}" for j in range(30))) for k in range(400)]
    rows += [(1000 + k, "copy", rows[k][2]) for k in range(5)] + [(None, "n", rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows[:400], rows[-1]], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" in plan and "Union" in plan
    may, others = ng.by_membership(docs.where("doc_id IS NOT NULL"), ["doc_id"], docs.where("source = 'copy'"))
    assert {r.doc_id for r in may.collect()} >= {1000 + k for k in range(5)} and others.count() > 300
    assert may.count() + others.count() == 405
