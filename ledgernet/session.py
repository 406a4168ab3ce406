"""Session construction and lineage cutting.

The library never creates a session implicitly: callers pass a ``SparkSession``.
``build_session`` is a convenience for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgernet", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgernet-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Spark's switch for deleting a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup_lock = threading.Lock()
_cleanup = {"users": 0, "before": None}


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made inside the block are deleted when they
    end, not when the driver next collects its garbage.  Threads may be in it at once."""
    with _cleanup_lock:
        if not _cleanup["users"]:
            _cleanup["before"] = spark.conf.get(_CLEANUP, None)
        _cleanup["users"] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleanup_lock:
            _cleanup["users"] -= 1
            if not _cleanup["users"]:
                if _cleanup["before"] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, _cleanup["before"])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of the block, which ``df`` may not be


def scratch_table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder (optionally
    partitioned, so later filters on those columns prune files) and read it
    back: a lineage cut that also enables partition pruning."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/ledgernet-scratch-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with passing_shuffles(df.sparkSession):
        w.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints and scratch tables written inside the block are deleted when
    it ends: results that are to stay are written elsewhere before."""
    sc = spark.sparkContext
    shared = ensure_checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[0]
    inner = f"{shared}/passing-{uuid.uuid4().hex}"
    sc.setCheckpointDir(inner)
    try:
        yield
    finally:
        sc.setCheckpointDir(shared)
        delete_folder(spark, inner)
