"""Places in sorted groups of any size.

A window over a whole group would put a hot group into one task.  Rows are dealt
by ranges of (group, order) instead, so a large group spans several tasks; sums
run inside a range, and a range's offset comes from a window over the few
ranges of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgernet.session import scratch_table

#: Rows of one array when equal rows are written out again.
COPIES = 4096


def places(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str | Column]) -> DataFrame:
    """``rows`` with, for every ``name: weight`` of ``sums``, the sum of the
    weight over the rows that stand before in the group (nulls first).  Group
    columns hold no nulls; (group, order) is unique, or equal rows would share
    a range (``grouped copies`` carry a weight instead)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ascending = [F.col(c).asc_nulls_first() for c in order]
    weights = {name: (F.col(w) if isinstance(w, str) else w) for name, w in sums.items()}
    dealt = scratch_table(rows.repartitionByRange(n, *group, *ascending)
                          .withColumn("range_no", F.spark_partition_id()))
    inside = Window.partitionBy("range_no", *group).orderBy(*ascending).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_no", *group).agg(*[F.sum(w).alias(f"{name}_total") for name, w in weights.items()])
    offsets = totals.select("range_no", *group, *[
        F.coalesce(F.sum(f"{name}_total").over(earlier), F.lit(0)).alias(f"{name}_offset") for name in weights])
    out = dealt.withColumns({f"{name}_inside": F.coalesce(F.sum(w).over(inside), F.lit(0)) for name, w in weights.items()})
    return out.join(offsets, ["range_no", *group]).select(
        *rows.columns, *[(F.col(f"{name}_inside") + F.col(f"{name}_offset")).cast("long").alias(name) for name in weights])


def write_out(rows: DataFrame, copies: str, place: str) -> DataFrame:
    """One row per copy, ``place`` counted on; arrays stay under ``COPIES``."""
    last = F.col(copies) - 1
    return (rows.withColumn("copy_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES).cast("long"))))
            .withColumn("copy_no", F.explode(F.sequence(F.col("copy_run") * COPIES,
                                                        F.least(last, (F.col("copy_run") + 1) * COPIES - 1))))
            .withColumn(place, F.col(place) + F.col("copy_no")).drop("copy_run", "copy_no", copies))
