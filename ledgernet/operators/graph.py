"""Graph construction from a transaction (edge) table.

The edge DataFrame *is* the graph; nothing is materialised per node.  A
multigraph keeps one row per transaction; its collapse carries the multiplicity
``n_tx`` so that counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet.functions.scalars import log_bucket
from ledgernet.session import cut_lineage


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per directed pair: ``n_tx`` transactions, summed amount,
    latest timestamp; a missing attribute counts as 0."""
    cols = set(edges.columns)
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0)) if "amount" in cols else F.lit(0.0)
    ts = F.coalesce(F.col("timestamp").cast("long"), F.lit(0)) if "timestamp" in cols else F.lit(0)
    return (edges.groupBy("source", "target")
            .agg(F.count(F.lit(1)).alias("n_tx"), F.sum(amount).alias("amount"),
                 F.max(ts).alias("timestamp")))


def simple_edges(edges: DataFrame) -> DataFrame:
    """The simple directed graph (parallel transactions collapse)."""
    return edges.select("source", "target").distinct()


def unweighted_edge_list(edges: DataFrame) -> DataFrame:
    """Simple edges with ``weight = 1``."""
    return simple_edges(edges).withColumn("weight", F.lit(1.0))


def node_incidence_totals(collapsed: DataFrame) -> DataFrame:
    """Per node: summed amount / timestamp and simple degree over in- and out-edges
    of the collapsed graph (a self-loop is seen from both ends, so it counts twice)."""
    sides = collapsed.select(
        F.explode(F.array(F.col("source"), F.col("target"))).alias("node"),
        "amount", "timestamp")
    return (sides.groupBy("node")
            .agg(F.sum("amount").alias("amount_total"),
                 F.sum(F.col("timestamp").cast("double")).alias("timestamp_total"),
                 F.count(F.lit(1)).alias("degree")))


def weighted_edge_list(edges: DataFrame) -> DataFrame:
    """G4+G5: collapse parallel edges, then normalise amount, timestamp and
    multiplicity by the *source's* totals over all its incident edges; the edge
    weight is the product.  Totals are the original (not progressively
    normalised) ones; a zero total gives a zero factor."""
    g = collapse_edges(edges)
    tot = node_incidence_totals(g).withColumnRenamed("node", "source")
    j = g.join(tot, "source")
    amt = F.when(F.col("amount_total") != 0, F.col("amount") / F.col("amount_total")).otherwise(0.0)
    tsn = F.when(F.col("timestamp_total") != 0,
                 F.col("timestamp").cast("double") / F.col("timestamp_total")).otherwise(0.0)
    ntx = F.col("n_tx").cast("double") / F.col("degree")
    return j.select("source", "target", (amt * tsn * ntx).alias("weight"))


def read_weighted(edges: DataFrame) -> DataFrame:
    """A simple weighted digraph from an edge list; a missing weight is 1 and
    duplicate pairs keep their last-seen weight semantics as one row (max)."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return (edges.select("source", "target", w.alias("weight"))
            .groupBy("source", "target").agg(F.max("weight").alias("weight")))


def out_adjacency(edges: DataFrame) -> DataFrame:
    """G7 in long form: one row per (source, successor) with the source's
    out-degree.  Successor lists are never gathered into arrays, so a hub never
    becomes a single oversized row."""
    s = simple_edges(edges)
    deg = s.groupBy("source").agg(F.count(F.lit(1)).alias("out_degree"))
    return s.join(deg, "source")


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree on the simple graph and its log bucket ``floor(log2(d+1))``
    for every node (0 for nodes without successors)."""
    deg = (simple_edges(edges).groupBy("source").agg(F.count(F.lit(1)).alias("out_degree"))
           .withColumnRenamed("source", "node"))
    d = F.coalesce(F.col("out_degree"), F.lit(0)).cast("long")
    return (nodes.select("node").join(deg, "node", "left")
            .select("node", d.alias("out_degree"), log_bucket(d).alias("log_degree")))


def graph_nodes(edges: DataFrame) -> DataFrame:
    return (edges.select(F.explode(F.array("source", "target")).alias("node")).distinct())


def graph_summary(edges: DataFrame) -> DataFrame:
    """Node count, transaction count, distinct directed pairs, self-loops."""
    pairs = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    agg = pairs.agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_pairs"),
                    F.sum(F.when(F.col("source") == F.col("target"), F.col("n")).otherwise(0)).alias("n_self_loop_tx"))
    n_nodes = graph_nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    return n_nodes.crossJoin(agg)


def dense_ids(nodes: DataFrame, col: str = "node") -> DataFrame:
    """Dense ids 0..N-1 in node order, with the inverse map as the same table.

    Nodes are sorted in ranges; a node's id is its place in its range plus the
    rows of the ranges before.  The only window without a key is over one row
    per range."""
    placed = cut_lineage(nodes.select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
                         .select(col, F.monotonically_increasing_id().alias("__at")))
    placed = placed.select(col, F.shiftright("__at", 33).alias("__range"),
                           F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
               .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    return placed.join(offsets, "__range").select(col, (F.col("__off") + F.col("__place")).alias("dense_id"))
