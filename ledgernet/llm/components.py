"""Connected components of a link table, as contraction rounds in Spark.

In a round every node takes the smallest id among itself and its neighbours;
links are renamed to those ids, loops and repeats go, and the labels found so
far are renamed too.  Each round is written to the shared folder, so a lost
executor costs one round.  Hubs are reduced by partial aggregation; the joins
have one row per node on one side, so AQE can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.session import scratch_table


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` → ``(node, component)`` for every node that has a link
    to another node; ``component`` is its smallest reachable node."""
    links = scratch_table(links.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = scratch_table(both.groupBy("node").agg(
            F.least(F.min("node"), F.min("to")).alias("up")))
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        renamed = (links.join(left, "a").join(right, "b").where("ua <> ub")
                   .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "up")
            labels = scratch_table(labels.join(step, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")))
        links = scratch_table(renamed)
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
