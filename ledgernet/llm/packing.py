"""Best-fit packing by sums of squares.

Documents become id pieces of at most ``CAPACITY`` (only longer ones are cut);
pieces go into sequences of ``CAPACITY`` places.  Each piece is placed where
the sum, over the residual gaps, of the squared number of open sequences with
that gap becomes smallest; ties go to the smaller gap.  Pieces are taken in
falling order of length.

Full pieces are sequences of their own.  The others are dealt by a hash of piece
and row number (so that equal rows spread) over shards of about ``SHARD`` pieces, each a fair mix of the lengths, and every
shard is packed in one task (two numbers a piece).  The sequences of a shard
that stay under ``FULL`` of their capacity are opened again and packed in a
second round, over fewer shards, so that shards cost no more than their last
few sequences.

Defined results: null text is empty (the end id alone); repeated rows are
packed each; a null ``doc_id`` is packed like any other; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.common import group_batches, text_batches
from ledgernet.llm.tokens import tokenizer
from ledgernet.session import scratch_table

CAPACITY, SHARD, FULL = 2048, 65_536, 0.995
#: Documents that are encoded together; words that a worker remembers.
TEXTS, REMEMBERED = 128, 800_000


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, REMEMBERED)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                some = b.slice(k, TEXTS)
                rows, piece, start, length, crc = [], [], [], [], []
                for r, raw in enumerate(encode.encode([t or "" for t in some.column("text").to_pylist()])):
                    raw += end
                    for p, a in enumerate(range(0, len(raw), step)):
                        part = raw[a:a + step]
                        rows.append(r)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece (pieces in the order given)."""
    open_ = np.zeros(capacity + 1, np.int64)  # sequences per residual gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    n, never = 0, 1 << 60
    for k, size in enumerate(lengths.tolist()):
        # gap g -> g - size changes the sum by 2 (N[g-size] - N[g]) + 2; a gap of
        # 0 counts for nothing, and a new sequence has no gap to leave
        gain = 2 * (open_[:capacity - size + 1] - open_[size:]) + 2
        gain[0] = 1 - 2 * open_[size]
        gain[open_[size:] == 0] = never
        gain[capacity - size] = 2 * open_[capacity - size] + 1 if size < capacity else 0
        g = int(gain.argmin()) + size
        if g == capacity:
            s = n
            n += 1
        else:
            s = by_gap[g].pop()
            open_[g] -= 1
        seq[k], offset[k] = s, capacity - g
        if g > size:
            open_[g - size] += 1
            by_gap[g - size].append(s)
    return seq, offset


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "shard", least_rows=1):
            t = t.combine_chunks()
            shard = t.column("shard").to_numpy()
            length = t.column("length").to_numpy()
            cut = np.append(np.flatnonzero(np.insert(shard[1:] != shard[:-1], 0, True)), len(shard))
            for a, z in zip(cut[:-1], cut[1:]):
                order = a + np.argsort(-length[a:z], kind="stable")
                seq, offset = place(length[order], capacity)
                fill = np.bincount(seq, weights=length[order]).astype(np.int64)[seq]
                rows = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [t.column(c).combine_chunks().take(rows) for c in _PIECE]
                    + [pa.array((shard[order].astype(np.int64) << 32) + seq), pa.array(offset), pa.array(fill)],
                    names=[*_PIECE, "sequence_id", "offset", "fill"])
    return run


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_KINDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _round(pieces: DataFrame, n: int, first: int, shard: int, capacity: int) -> DataFrame:
    shards = max(1, -(-n // shard))
    return (pieces.withColumn("shard", F.lit(first) + F.pmod(
                F.xxhash64(F.lit(first), *_PIECE, F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
            .repartition("shard").sortWithinPartitions("shard", *_PIECE)
            .mapInArrow(_pack(capacity), _KINDS + ", sequence_id long, offset long, fill long"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, full: float = FULL) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id``
    and ``offset``."""
    pieces = pieces.select(*_PIECE)
    alone = pieces.where(F.col("length") >= capacity).select(
        *_PIECE, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    packed = _round(rest, n, 0, shard, capacity)
    if n > shard:
        packed = scratch_table(packed)
        loose = packed.where(F.col("fill") < full * capacity)
        again = _round(loose.select(*_PIECE), loose.count(), 1 << 30, shard, capacity)
        packed = packed.where(F.col("fill") >= full * capacity).unionByName(again)
    return alone.unionByName(packed.select(*_PIECE, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY,
                   shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, text)`` → ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``, a row per piece."""
    text_batches(docs.sparkSession)
    pieces = scratch_table(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, end_id, capacity), _KINDS))
    return pack_pieces(pieces, capacity, shard)
