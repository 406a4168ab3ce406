"""Writers (S9-S15).  Parquet is the default; every write is a distributed job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.draws import uniform


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Feature tables, edge and node lists, feature rankings."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def write_feature_sets(path: str, engineered: DataFrame, published: DataFrame, merged: DataFrame) -> None:
    """S9 (three tables: engineered, published subset, merged)."""
    write_table(engineered, f"{path}/engineered")
    write_table(published, f"{path}/published")
    write_table(merged, f"{path}/merged")


def write_walks(walks: DataFrame, path: str, shuffle_seed: int | None = 42, shards: int | None = None) -> None:
    """One walk per line, tokens space-separated.  With a seed, walks are
    dealt to ``shards`` files (default: the shuffle partitions) by a hash of their
    key and put in a keyed random order inside each, so no walk order is sorted as
    a whole; :func:`readers.read_walks` reads the files in turn, a line of each."""
    lines = walks.select(F.concat_ws(" ", "tokens").alias("value"), "root", "walk_no")
    if shuffle_seed is not None:
        count = shards or int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = (lines.withColumn("__k", F.concat_ws("|", F.lit(shuffle_seed), "root", "walk_no"))
                 .repartition(count, "__k").sortWithinPartitions(uniform(shuffle_seed, "__k"), "__k"))
    lines.select("value").write.mode("overwrite").text(path)


def write_word2vec_text(emb: DataFrame, path: str, dimensions: int) -> None:
    """word2vec text format (header ``count dim``, then ``node v1 .. vd``)."""
    spark = emb.sparkSession
    n = emb.count()
    header = spark.createDataFrame([(f"{n} {dimensions}",)], "value string")
    body = emb.select(F.concat_ws(" ", F.col("node").cast("string"),
                                  F.transform("vector", lambda x: x.cast("string"))).alias("value"))
    header.unionByName(body).write.mode("overwrite").text(path)


def _write_run(rows: DataFrame, path: str) -> None:
    """Replaces the rows of the runs in ``rows`` and leaves those of others: a
    run that is done again, or retried after a failure, doesn't double them."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def append_stats(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Adds the metric rows of ``run`` to the stats table (created on first
    use), in place of those that the run wrote before.  Without a name the run
    is a new one."""
    _write_run(rows.withColumn("run", F.lit(run or uuid.uuid4().hex)), path)


def append_run_log(spark, path: str, run: str, seconds: float) -> None:
    """One ``(run, run_seconds)`` row per embedding run."""
    _write_run(spark.createDataFrame([(run, float(seconds))], "run string, run_seconds double"), path)
