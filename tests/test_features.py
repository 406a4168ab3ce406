import math

from brute import egonet, tx_features

from ledgernet.operators import egonet as ego
from ledgernet.operators import transactions as tx
from ledgernet.operators import features as feat
from conftest import MICRO_EDGES


def _close(a, b):
    if isinstance(b, float) and math.isinf(b):
        return a == b
    return abs(float(a) - float(b)) <= 1e-9 * max(1.0, abs(float(b)))


def _check(rows, expected):
    assert set(rows) == set(expected)
    for n, exp in expected.items():
        for k, v in exp.items():
            assert _close(rows[n][k], v), (n, k, rows[n][k], v)


def test_transaction_features_match_brute_force(micro):
    e, _ = micro
    rows = {r["node"]: r.asDict() for r in tx.transaction_features(e).collect()}
    _check(rows, tx_features(MICRO_EDGES))


def test_gap_buckets_do_not_change_results(micro):
    e, _ = micro
    a = {r["node"]: r.asDict() for r in tx.transaction_features(e).collect()}
    b = {r["node"]: r.asDict() for r in tx.transaction_features(e, rows_per_bucket=1).collect()}
    _check(b, a)


def test_hand_values(micro):
    e, _ = micro
    r = {x["node"]: x for x in tx.transaction_features(e).collect()}
    # node 3: self-loop counted once in "all", twice across in/out
    assert (r[3]["degree"], r[3]["in_degree"], r[3]["out_degree"]) == (6, 4, 3)
    # node 1 incoming at t = 0, 240, 10: gaps 10/60 and 230/60 minutes
    assert _close(r[1]["sum_in_tx_interval"], 240 / 60)
    # equal timestamps give a zero gap: node 4 has 90 (in) and 90 (out)
    assert r[4]["min_all_tx_interval"] == 0.0


def test_egonet_multigraph_matches_brute_force(micro):
    e, _ = micro
    rows = {r["node"]: r.asDict() for r in ego.egonet_features(e, "multi").collect()}
    _check(rows, egonet(MICRO_EDGES, "multi"))


def test_egonet_simple_matches_brute_force(micro):
    e, _ = micro
    rows = {r["node"]: r.asDict() for r in ego.egonet_features(e, "simple").collect()}
    _check(rows, egonet(MICRO_EDGES, "simple"))


def test_triangles_listed_once(micro):
    e, _ = micro
    from pyspark.sql import functions as F
    g = e.groupBy("source", "target").agg(F.count("*").alias("c"), F.sum("amount").alias("a"))
    tri = {tuple(sorted((r["x"], r["y"], r["z"]))) for r in ego.triangles(g).collect()}
    und = {tuple(sorted(p)) for p in {(s, t) for s, t, *_ in MICRO_EDGES if s != t}}
    nodes = sorted({x for p in und for x in p})
    brute = {(a, b, c) for a in nodes for b in nodes for c in nodes if a < b < c
             and (a, b) in und and (a, c) in und and (b, c) in und}
    assert tri == brute and len(brute) > 0
    assert ego.triangles(g).count() == len(brute)


def test_feature_table_zero_fills_isolated_nodes(micro):
    e, n = micro
    f = {r["node"]: r for r in feat.node_features(e, n).collect()}
    assert set(f) == set(range(1, 8))
    assert f[7]["degree"] == 0 and f[7]["no_edge_within_egonet"] == 0 and f[7]["ent_amount_all_tx"] == 0.0
    cols = feat.node_features(e, n).columns
    assert len(cols) == 71 and cols[:4] == ["node", "address", "isp", "is_anchor"]


def test_anchor_roots_subset(micro):
    e, n = micro
    a = feat.node_features(e, n, roots=feat.anchors(n))
    assert sorted(r["node"] for r in a.collect()) == [1, 2, 4, 6]


def test_roots_pushdown_gives_same_rows(micro):
    e, n = micro
    roots = feat.anchors(n)
    full = {r["node"]: r.asDict() for r in feat.node_features(e, n).collect()}
    part = {r["node"]: r.asDict() for r in feat.node_features(e, n, roots=roots).collect()}
    assert set(part) == {1, 2, 4, 6}
    for k, row in part.items():
        assert row == full[k]
    s_full = {r["node"]: r.asDict() for r in feat.simple_node_features(e, n).collect()}
    s_part = {r["node"]: r.asDict() for r in feat.simple_node_features(e, n, roots=roots).collect()}
    assert all(s_part[k] == s_full[k] for k in s_part)


def test_hubs_null_times_and_null_nodes_among_small_nodes(spark):
    import random

    r = random.Random(6)
    rows = [(r.choice((1, 1, 1, 2, 3, 4, None)), r.choice((1, 2, 3, 5, None)), r.choice((None, 0, 60, 60, 90, 300, 4000)),
             r.choice((None, 0.0, -2.5, 3.0, 10.0))) for _ in range(120)]
    e = spark.createDataFrame(rows, "source long, target long, timestamp long, amount double")
    a, b, c = ({x["node"]: {k: v for k, v in x.asDict().items() if k != "node"} for x in tx.transaction_features(e, rows_per_bucket=n).collect()}
               for n in (1 << 20, 60, 1))
    assert set(a) == {1, 2, 3, 4, 5, None}
    _check(b, a)   # the hub node 1 apart
    _check(c, a)   # each node a hub
    times = sorted(x[2] for x in rows if 4 in x[:2] and x[2] is not None)
    timeless = sum(1 for x in rows if 4 in x[:2] and x[2] is None)
    assert _close(a[4]["sum_all_tx_interval"], (times[-1] - times[0]) / 60)
    assert _close(a[4]["avg_all_tx_interval"], (times[-1] - times[0]) / 60 / (len(times) - 1 + max(0, timeless - 1)))
