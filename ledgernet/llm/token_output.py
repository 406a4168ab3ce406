"""Token ids as Arrow files of equal-length sequences.

``write_tokens`` deals the documents to tasks by ranges of ``doc_id``; each
task writes the ids of its documents, in ascending order and one after the
other, as an Arrow IPC *file* of fixed-size lists: ``ids`` (``length`` ids,
16-bit if the vocabulary allows) and ``mask`` (false on the padding of a file's
last sequence).  Sequence k of a file is element ``k % BATCH`` of its record
batch ``k // BATCH``, a zero-copy slice of a memory map.  A second file holds
``doc_id, start, n_tokens`` of its documents.

A task writes under a name of its own and returns it; the names that the
finished job returned are the output (``manifest``), so a lost executor or a
second attempt leaves no wrong file in it.

Defined results: null text is empty (the end id alone); rows with equal ids
stand in the order of their text hashes; a null ``doc_id`` comes first; an empty
table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgernet.llm.common import text_batches, text_key
from ledgernet.llm.tokens import tokenizer
from ledgernet.session import ensure_checkpoint_dir, scratch_table

LENGTH, BATCH = 2048, 64


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class SequenceWriter:
    """Appends ids to an Arrow file, cut into sequences of ``length``."""

    def __init__(self, path: str, length: int, width: np.dtype):
        fs, name = filesystem(path)
        self.length, self.width = length, np.dtype(width)
        self.kind = pa.list_(pa.from_numpy_dtype(self.width), length)
        self.schema = pa.schema([("ids", self.kind), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(name)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n += len(ids)
        if self.n >= self.length * BATCH:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        step = self.length * BATCH
        end = len(flat) if final else len(flat) // step * step
        for a in range(0, end, step):
            part = flat[a:min(a + step, end)]
            full = -(-len(part) // self.length) * self.length
            mask = np.arange(full) < len(part)
            self.file.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(np.pad(part, (0, full - len(part)))), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held = [flat[end:]]
        self.n = len(flat) - end

    def close(self) -> None:
        self._write(final=True)
        self.file.close()
        self.sink.close()


def _write(folder: str, path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        out = index = sink = None
        at = n_docs = 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            if out is None and b.num_rows:
                out = SequenceWriter(f"{name}.arrow", length,
                                     np.uint16 if max(encode.size, end_id + 1) <= 1 << 16 else np.uint32)
                fs, where = filesystem(f"{name}.docs.arrow")
                sink = fs.open_output_stream(where)
                index = pa.ipc.new_file(sink, schema)
            for i, j, ids, counts in encode.encode_column(b.column("text")):
                out.add(np.insert(ids, np.cumsum(counts), end_id))
                counts = counts + 1
                ends = at + np.cumsum(counts)
                index.write_batch(pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(ends - counts), pa.array(counts)], schema=schema))
                at = int(ends[-1])
                n_docs += j - i
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()),
                 pa.array([at], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])
    return run


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                 length: int = LENGTH) -> DataFrame:
    """Write the files; returns the manifest ``part, path, n_docs, n_tokens,
    start`` (ids in the parts before), one row per file pair."""
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, where = filesystem(folder)
    fs.create_dir(where, recursive=True)
    dealt = (docs.select("doc_id", "text", text_key().alias("dk")).repartitionByRange("doc_id")
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "dk").select("doc_id", "text"))
    files = scratch_table(dealt.mapInArrow(_write(folder, vocabulary, end_id, length),
                                           "part int, path string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """Reader of a file; local files are memory-mapped, so batches are views."""
    fs, name = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k; the ids are a view of the file."""
    batch = reader.get_batch(k // BATCH)
    return (batch.column("ids")[k % BATCH].values.to_numpy(),
            batch.column("mask")[k % BATCH].values.to_numpy(zero_copy_only=False))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, offset in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            reader = open_sequences(f"{path}.arrow")
            docs = open_sequences(f"{path}.docs.arrow")
            length = reader.schema.field("ids").type.list_size
            step = length * BATCH
            have, flat = -1, None
            for i in range(docs.num_record_batches):
                rows = docs.get_batch(i)
                crcs = []
                for a, n in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist()):
                    crc, z = 0, a + n
                    while a < z:
                        if a // step != have:
                            have = a // step
                            flat = reader.get_batch(have).column("ids").flatten().to_numpy()
                        to = min(z, (have + 1) * step)
                        crc = zlib.crc32(flat[a - have * step:to - have * step].astype("<u4").tobytes(), crc)
                        a = to
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(rows.column("start").to_numpy() + offset),
                     rows.column("n_tokens"), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the
    files of a manifest, a file a task."""
    files = max(1, manifest.count())
    return manifest.select("part", "path", "start").repartitionByRange(files, "part").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    return read_tokens(write_tokens(docs, vocabulary, end_id))
