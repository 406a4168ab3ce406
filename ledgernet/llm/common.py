"""Shared helpers: Arrow text buffers, bounded sub-batches, document keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (several 8-byte arrays of
#: this length live at once).
STEP_BYTES = 500_000


#: Most rows of an Arrow batch that carries whole texts to a Python worker.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``TEXT_ROWS``: the default of
    10,000 rows of text is a multiple of what a step works on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """Part of a row's key next to ``doc_id``, so that rows that share an id
    but not a text are told apart; equal rows get equal results."""
    return F.xxhash64(F.col(text))


#: Stands for a null ``doc_id`` in keys, so that plain equi-joins find it.
NO_ID = -(1 << 63)


def keyed_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` (``NO_ID`` for null), ``text``, ``dk`` of every row."""
    text_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       "text", text_key().alias("dk"))


def with_spans(docs: DataFrame, spans: DataFrame, *fields: str) -> DataFrame:
    """Every row's ``doc_id, dk, text`` and ``spans``, the array of the spans
    (bounded by its text) that ``spans(doc_id, dk, ...)`` holds for its key;
    null where there is none."""
    lists = spans.groupBy("doc_id", "dk").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return (keyed_text(docs).join(lists, ["doc_id", "dk"], "left")
            .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "dk", "text", "spans"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def group_batches(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 1 << 14,
                  least_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as tables that end at a key's border, once they
    hold ``least_rows`` rows or ``least_bytes`` bytes.  The caller's groups are
    bounded."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < least_rows and size < least_bytes:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        border = np.flatnonzero(keys[1:] != keys[:-1])
        if not len(border):
            continue
        cut = int(border[-1]) + 1
        held[-1] = b.slice(0, cut)
        yield pa.Table.from_batches(held)
        held = [b.slice(cut)]
        rows, size = held[0].num_rows, 0
    if held:
        yield pa.Table.from_batches(held)
