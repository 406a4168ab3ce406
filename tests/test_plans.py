"""Plan guards: the core operators compile to equi-joins and aggregations only
(no Cartesian products, no nested-loop joins), and scans are pruned."""

from ledgernet.operators import egonet as ego
from ledgernet.operators import graph as gr
from ledgernet.operators import transactions as tx
from ledgernet.operators import walks as wk
from ledgernet.operators.scaling import zscore
from ledgernet.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _no_product(plan):
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


def test_core_plans_have_no_products(spark, micro):
    e, n = micro
    _no_product(_plan(tx.transaction_features(e)))
    _no_product(_plan(ego.egonet_features(e, "multi")))
    _no_product(_plan(gr.weighted_edge_list(e)))
    _no_product(_plan(zscore(tx.transaction_features(e), ["degree", "sum_amount_all_tx"])))
    w = gr.weighted_edge_list(e)
    _no_product(_plan(wk.first_order_transitions(w)))


def test_roots_come_before_triangles(spark):
    """Triangles are listed among N[roots] only, with the same features."""
    pairs = [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (4, 5), (5, 3), (6, 7), (7, 8), (6, 8), (2, 2)]
    e = spark.createDataFrame([(a, b, k, float(a + b)) for k, (a, b) in enumerate(pairs)],
                              "source long, target long, timestamp long, amount double")
    roots = spark.createDataFrame([(1,), (8,)], "node long")
    near = {(r["source"], r["target"]) for r in ego.near_roots(e, roots).collect()}
    assert near == {(1, 2), (2, 3), (1, 3), (3, 1), (2, 2)}
    for variant in ("multi", "simple"):
        some = ego.egonet_features(e, variant, roots=roots).orderBy("node").collect()
        every = ego.egonet_features(e, variant).where("node IN (1, 8)").orderBy("node").collect()
        assert [[round(x, 9) for x in r] for r in some] == [[round(x, 9) for x in r] for r in every]


def test_fixture_scan_is_pruned_and_whole(spark):
    folder = "/root/testdata/sf0.001"
    edges = fx.tx_edges(spark, folder)
    plan = _plan(edges)
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    assert "o_orderstatus" not in scan                       # column pruning
    _no_product(plan)
    # every order is a transaction between two accounts
    nodes = fx.tx_nodes(spark, folder)
    assert edges.count() == fx.table(spark, folder, "orders").count()
    assert nodes.count() == fx.ACCOUNTS * fx.table(spark, folder, "customer").count()
    assert edges.join(nodes, edges["target"] == nodes["node"], "left_anti").isEmpty()
    assert edges.join(nodes, edges["source"] == nodes["node"], "left_anti").isEmpty()


def test_nodes_without_a_hub_are_dealt_once(spark, micro):
    e, _ = micro
    plan = _plan(tx.transaction_features(e))
    assert plan.count("Exchange") == 1 and plan.count("Window ") == 1, plan
