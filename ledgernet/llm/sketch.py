"""Count-min sketch of 64-bit hashes over a whole corpus.

Each partition sketches its own hashes (``depth`` rows of ``width`` cells,
counts saturating at 2); the partitions' sketches are merged cell by cell in
blocks, as they stream through the task of a block.  A hash is *estimated
repeated* when all its cells hold 2 or more, which overestimates and so loses
no repeated hash.  Only one bit per cell is kept: ``depth * width / 8`` bytes,
at most 3 * 2**28 / 8 = 100 MB, the proven bound of what is broadcast.  Beyond
the bound's comfortable load the sketch passes more hashes, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
DEPTH = 3
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 28, 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def width_bits(expected: int) -> int:
    """Bits of a row's width: twice the expected hashes, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, int(2 * max(expected, 1)).bit_length()))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h ^ (h >> U(31))) * U(_ODD[row])) >> U(64 - bits)


def _partition_sketch(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    block_bits = min(BLOCK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            for row in range(DEPTH):
                cell, n = np.unique(cells(h, row, bits), return_counts=True)
                block = (cell >> U(block_bits)).astype(np.int64)
                cut = np.flatnonzero(np.diff(block, prepend=-1))
                local = (cell & U((1 << block_bits) - 1)).astype(np.uint32)
                parts = zip(cut, np.append(cut[1:], len(cell)))
                blocks, once, twice = [], [], []
                for a, z in parts:
                    blocks.append(row * (1 << (bits - block_bits)) + int(block[a]))
                    many = n[a:z] > 1
                    once.append(local[a:z][~many].tobytes())
                    twice.append(local[a:z][many].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                    names=["block", "once", "twice"])

        held, n = [], 0
        for b in batches:
            for h in hashes(b):
                held.append(h)
                n += len(h)
            if n > 4_000_000:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)
    return run


def _merge(bits: int):
    block_bits = min(BLOCK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())],
                names=["block", "bits"])

        for b in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if now is not None:
                        yield done()
                    now, count = block, np.zeros(1 << block_bits, np.uint8)
                one = np.frombuffer(once, np.uint32)
                count[one] = np.minimum(count[one] + 1, 2)
                count[np.frombuffer(twice, np.uint32)] = 2
        if now is not None:
            yield done()
    return run


class Repeated:
    """Which hashes the merged sketch estimates to be repeated."""

    def __init__(self, bits: int, maps: dict[int, bytes]):
        self.bits, self.maps = bits, maps
        self._cells: np.ndarray | None = None

    def __getstate__(self):
        return (self.bits, self.maps)

    def __setstate__(self, state):
        self.bits, self.maps = state
        self._cells = None

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self._cells is None:
            size = 1 << (min(BLOCK_BITS, self.bits) - 3)
            flat = np.zeros(DEPTH << (self.bits - 3), np.uint8)
            for block, data in self.maps.items():
                flat[block * size:(block + 1) * size] = np.frombuffer(data, np.uint8)
            self._cells, self.maps = flat, {}
        keep = np.ones(len(h), bool)
        for row in range(DEPTH):
            at = cells(h, row, self.bits).astype(np.int64) + (row << self.bits)
            keep &= (self._cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return keep


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
             expected: int) -> Repeated:
    """Sketch ``hashes(batch)`` of all rows; the bit maps come to the driver
    (bounded, see above) to be broadcast."""
    bits = width_bits(expected)
    parts = rows.mapInArrow(_partition_sketch(hashes, bits), "block long, once binary, twice binary")
    merged = (parts.repartition("block").sortWithinPartitions("block")
              .mapInArrow(_merge(bits), "block long, bits binary"))
    return Repeated(bits, {r["block"]: bytes(r["bits"]) for r in merged.collect()})  # one job, not one a partition


def members(rows: DataFrame, column: str, expected: int) -> Repeated:
    """Which values of a 64-bit hash column may occur in ``rows``: the same
    sketch with every value counted twice.  It passes some others, loses none."""
    def twice(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        h = b.column(0).to_numpy().view(U)
        yield np.concatenate([h, h])

    return repeated(rows.select(column), twice, expected)
