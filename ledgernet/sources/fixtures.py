"""Graph views derived from the driver's TPC-H-like tables.

* ``tx_edges``   one directed transaction per order: the ``source`` is the
  customer's account for that order priority (``5 * o_custkey`` + 0 to 4), the
  ``target`` a hashed account, with epoch-seconds ``timestamp`` and
  ``amount = o_totalprice`` (a multigraph with cycles).
* ``tx_nodes``   one node per account, five a customer; the address is the
  account number as text (shared with the published set), ``isp = 1`` for
  negative balances, anchors are the illicit nodes plus every tenth account.
* ``pub_features`` / ``pub_classes``  a positional published-feature table and
  its class file, from the ``embeddings`` table.

Every view is a lazy plan over the parquet files, so filters and column
pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.functions.scalars import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Accounts of a customer: one for each order priority, 1 to 5.
ACCOUNTS = 5
#: Order keys are reduced by it before squaring, so that no square overflows.
SQUARE_MODULUS = 1_000_003


def tx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # one scalar (a metadata-only count of the customer table) becomes a literal
    n = F.lit(ACCOUNTS * table(spark, sf_dir, "customer").count()).cast("long")
    source = F.col("o_custkey") * ACCOUNTS + F.substring("o_orderpriority", 1, 1).cast("long") - 1
    k = F.pmod(F.col("o_orderkey"), F.lit(SQUARE_MODULUS))
    return orders.select(source.alias("source"),
                         F.pmod(source * 31 + k * k + F.col("o_orderkey"), n).alias("target"),
                         epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
                         F.col("o_totalprice").cast("double").alias("amount"))


def tx_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = F.explode(F.array(*[F.lit(k) for k in range(ACCOUNTS)]))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", accounts.alias("k"))
    node = F.col("c_custkey") * ACCOUNTS + F.col("k")
    neg = F.col("c_acctbal") < 0
    return cust.select(
        node.alias("node"),
        node.cast("string").alias("address"),
        F.when(neg, 1).otherwise(0).cast("int").alias("isp"),
        F.when(neg | (F.pmod(node, F.lit(10)) == 0), 1).otherwise(0).cast("int").alias("is_anchor"),
    )


def pub_features(spark: SparkSession, sf_dir: str, n_features: int = 64) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("address"),
        F.pmod(F.col("vec_id"), F.lit(49)).alias("timestamp"),
        *[F.col("embedding")[i].cast("double").alias(f"f_{i}") for i in range(n_features)],
    )


def pub_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    lbl = F.col("label")
    return emb.select(
        F.col("vec_id").cast("string").alias("txId"),
        F.when(lbl == 0, "1").when(lbl.between(1, 6), "2").otherwise("unknown").alias("label"),
    )


# DuckDB twins (used by the oracle SQL).
TX_EDGES_SQL = f"""(SELECT source,
       (source * 31 + (o_orderkey % {SQUARE_MODULUS}) * (o_orderkey % {SQUARE_MODULUS}) + o_orderkey) % nc.n AS target,
       cast(epoch(o_orderdate) AS BIGINT) AS "timestamp",
       cast(o_totalprice AS DOUBLE) AS amount
  FROM (SELECT *, o_custkey * {ACCOUNTS} + cast(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS source FROM orders),
       (SELECT {ACCOUNTS} * count(*) AS n FROM customer) AS nc)"""

TX_NODES_SQL = f"""(SELECT node, cast(node AS VARCHAR) AS address,
       CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS isp,
       CAST(CASE WHEN c_acctbal < 0 OR node % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_anchor
  FROM (SELECT *, c_custkey * {ACCOUNTS} + k AS node FROM customer, range({ACCOUNTS}) r(k)))"""

PUB_CLASSES_SQL = """(SELECT cast(vec_id AS VARCHAR) AS "txId",
       CASE WHEN label = 0 THEN '1' WHEN label BETWEEN 1 AND 6 THEN '2' ELSE 'unknown' END AS label
  FROM embeddings)"""


def pub_features_sql(n_features: int = 64) -> str:
    cols = ", ".join(f"cast(embedding[{i + 1}] AS DOUBLE) AS f_{i}" for i in range(n_features))
    return f"""(SELECT cast(vec_id AS VARCHAR) AS address, vec_id % 49 AS "timestamp", {cols}
  FROM embeddings)"""
