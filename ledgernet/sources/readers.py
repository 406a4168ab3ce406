"""Readers with explicit schemas (S1-S8).  CSV with a header or Parquet; columns
are found by name, others are ignored, and a missing one is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgernet.catalog import CLASSES, EDGES, NODES, SIMPLE_EDGES, WEIGHTED_EDGES, published_feature_names


#: Columns of written tables that are not doubles.
TABLE_TYPES = {
    "node": "long", "timestamp": "long", "isp": "int", "is_anchor": "int", "select": "int",
    "address": "string", "txId": "string", "label": "string", "feature": "string",
    "index": "string", "exp_id": "string", "emb_method": "string", "classifier": "string",
}


def _read(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if path.endswith(".csv") or path.endswith(".edgelist") or path.endswith(".nodelist")
                  else "parquet")
    r = spark.read
    if fmt == "csv":
        # a schema given to the CSV reader would bind by position
        df = r.option("header", "true").option("inferSchema", "false").csv(path)
    else:
        df = r.parquet(path)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise ValueError(f"{path} lacks the columns {missing}; it has {df.columns}")
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return df


def read_edges(spark: SparkSession, path: str, with_attributes: bool = True, fmt: str | None = None) -> DataFrame:
    """Transaction edges (``source, target[, timestamp, amount]``)."""
    return _read(spark, path, EDGES if with_attributes else SIMPLE_EDGES, fmt)


def read_nodes(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Node list ``node, address, isp, is_anchor``."""
    return _read(spark, path, NODES, fmt)


def read_published_features(spark: SparkSession, path: str, fmt: str | None = None,
                            n_tx: int = 93, n_agg: int = 72) -> DataFrame:
    """S3: positional published features (no header), named by position."""
    names = published_feature_names(n_tx, n_agg)
    if (fmt or ("csv" if path.endswith(".csv") else "parquet")) == "csv":
        df = spark.read.option("header", "false").option("inferSchema", "false").csv(path)
        return df.toDF(*names).select(
            F.col("address").cast("string"), F.col("timestamp").cast("long"),
            *[F.col(c).cast("double") for c in names[2:]])
    return spark.read.parquet(path).toDF(*names)


def read_classes(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Class labels ``txId, label``."""
    return _read(spark, path, CLASSES, fmt)


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A feature table or a feature ranking written earlier."""
    if (fmt or ("csv" if path.endswith(".csv") else "parquet")) == "csv":
        df = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
        return df.select(*[F.col(f"`{c}`").cast(TABLE_TYPES.get(c, "double")).alias(c) for c in df.columns])
    return spark.read.parquet(path)


def read_weighted_edges(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``source, target[, weight]``; missing weight -> 1; of duplicate pairs the largest
    weight stays (rows have no order, so there is no last one)."""
    df = _read(spark, path, None, fmt)
    w = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    return (df.select(F.col("source").cast("long"), F.col("target").cast("long"), w.alias("weight"))
            .groupBy("source", "target").agg(F.max("weight").alias("weight")))


def read_node_attributes(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``node`` + attribute columns."""
    df = read_table(spark, path, fmt)
    return df.withColumn("node", F.col("node").cast("long"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """word2vec text format; the 2-token header line is skipped; returns
    ``node, emb_0..emb_{d-1}``.  The width is read from the header (one row)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("t"))
    header = lines.filter(F.size("t") == 2).first()
    data = lines.filter(F.size("t") > 2) if header is not None else lines
    d = int(header["t"][1]) if header is not None else len(data.first()["t"]) - 1
    return data.select(F.col("t")[0].cast("long").alias("node"),
                       *[F.col("t")[i + 1].cast("double").alias(f"emb_{i}") for i in range(d)])


def read_walks(spark: SparkSession, path: str, interleaved: bool = False) -> DataFrame:
    """Walk shards written by :func:`sinks.write_walks` (one walk per line).

    ``interleaved`` adds ``position`` (the line's number in its file, from 0) and
    ``shard``: ascending, they are the order in which training takes the first
    line of each file, then the second ones, and so on.  Only the lines of one
    file are ordered together, which the number of shards bounds."""
    tokens = F.split(F.trim("value"), " ").alias("tokens")
    if not interleaved:
        return spark.read.text(path).select(tokens)
    # a file's splits follow each other by their start, ids ascend inside a split
    lines = spark.read.text(path).select(tokens, F.col("_metadata.file_name").alias("shard"),
                                         F.col("_metadata.file_block_start").alias("__start"),
                                         F.monotonically_increasing_id().alias("__id"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("__start", "__id")) - 1
    return lines.select(place.cast("long").alias("position"), "shard", "tokens")
