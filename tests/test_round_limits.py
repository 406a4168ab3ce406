"""Bounds of what a query keeps on disk."""

import os
import time

from pyspark.sql import functions as F

from ledgernet.operators import graph as gr
from ledgernet.operators import traverse as trv
from ledgernet.session import cut_lineage, ensure_checkpoint_dir, passing_shuffles, scratch_table

EDGES = [(0, n) for n in range(1, 30)] + [(n, n % 7) for n in range(1, 30)] + [(7, 31), (31, 32), (32, 7), (32, 32)]


def _edges(spark):
    return spark.createDataFrame(sorted(set(EDGES)), "source long, target long")


def _paths(k):
    out = {}
    for s, t in set(EDGES):
        out.setdefault(s, []).append(t)
    found = {}
    for root in {n for e in EDGES for n in e}:
        ends, found[root] = [root], 1
        for _ in range(k):
            ends = [t for n in ends for t in out.get(n, [])]
            found[root] += len(ends)
    return found


def test_path_sizes_are_those_of_brute_force(spark):
    edges = _edges(spark)
    for k in (0, 1, 2, 3):
        got = trv.path_sizes(edges, gr.graph_nodes(edges), k).collect()
        assert {r["node"]: r["size"] for r in got} == _paths(k)


def test_roots_are_cut_by_their_paths(spark, monkeypatch):
    """Some batches of roots need no sketches, and none of them holds more rows than allowed and a ball."""
    edges, held = _edges(spark), []
    nodes = gr.graph_nodes(edges)
    monkeypatch.setattr(trv, "ball_sizes", None)

    def work(some):
        ball = trv.k_hop_ball(edges, some, 2)
        held.append(ball.count())
        return ball

    most = max(_paths(2).values())
    got = trv.in_root_batches(edges, nodes, 2, work, max_rows=most)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trv.k_hop_ball(edges, nodes, 2).collect()))
    assert len(held) > 1 and max(held) <= 2 * most


def test_shuffle_files_go_when_their_query_ends(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for n in names
                if n.startswith("shuffle_") and n.endswith(".data")}

    for write in (scratch_table, cut_lineage):
        there = shuffled()
        kept = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s"))
        until = time.time() + 20  # block managers are told, and delete on their own
        while shuffled() - there and time.time() < until:
            time.sleep(0.2)
        assert not shuffled() - there, write.__name__
        assert kept.count() == 7
    assert spark.conf.get(key) == before
    with passing_shuffles(spark), passing_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_a_layer_is_a_table_not_a_checkpoint(spark):
    """Layers were checkpoints: whole rows of longs, not compressed."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {n for n in os.listdir(folder) if n.startswith("rdd-")}
    trv.k_hop_ball(_edges(spark), gr.graph_nodes(_edges(spark)), 2)
    assert {n for n in os.listdir(folder) if n.startswith("rdd-")} == before
