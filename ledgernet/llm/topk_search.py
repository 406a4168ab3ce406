"""Exact top-k inner-product search by pivot-table elimination.

Vectors are integers (``floor(scale * x)``).  The table of distances between
every vector and ``PIVOTS`` pivots gives, for a query and a candidate, the
lower bound ``max |d(q, p) - d(c, p)|`` on their distance, and so an upper
bound on the inner product ``(|q|^2 + |c|^2 - distance^2) / 2``.  A task holds a
block of queries and a stream of candidate blocks; for each query it evaluates
a block's candidates in the order of their bounds, and stops when the next
bound is below the k-th score found so far; ties go to the smaller ``vec_id``,
so bounds equal to it are still evaluated.

Queries are cut into blocks of about ``QUERIES`` and every candidate block of
``CANDIDATES`` vectors meets each: a stated query set against all rows.  A task
keeps k rows a query; the tasks' rows are merged by a ranking that Spark limits
before its shuffle.

The pivots are the ``PIVOTS`` usable vectors with the smallest id hashes; only
they are broadcast.  Scores are exact: sums stay below 2**53 in doubles, or
64-bit integers are used.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a null ``vec_id`` takes none either; vectors of
different lengths don't meet; rows that share a ``vec_id`` are one vector (the
smallest stands); fewer than k candidates give fewer rows; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgernet.llm.common import text_buffer
from ledgernet.session import scratch_table

SCALE, TOP, PIVOTS = 1024, 10, 32
QUERIES, CANDIDATES, STEP = 512, 2048, 128


def usable(column: str = "embedding") -> Column:
    v = F.col(column)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    buf, offsets = text_buffer(column)
    return buf[int(offsets[0]):int(offsets[-1])].copy().view(np.int64).reshape(-1, dim)


#: Vectors of a larger norm, after scaling, are refused: the largest whole number
#: of 64 bits is about 3.037e9 squared.
LARGEST_NORM = 3e9


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("embedding")
            flat = rows.values.to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(flat * scale)
            offsets = rows.offsets.to_numpy()
            # by Cauchy-Schwarz no product of two vectors leaves the 64 bits then,
            # and sums that wrap on the way are right in the end
            squares = np.concatenate([[0.0], np.cumsum(whole ** 2)])
            if len(whole) and (np.abs(whole).max() >= LARGEST_NORM
                               or (squares[offsets[1:]] - squares[offsets[:-1]]).max(initial=0.0) >= LARGEST_NORM ** 2):
                raise ValueError("a vector's scaled norm is above 3e9: its scores may not fit 64 bits")
            ints = whole.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(np.diff(offsets).astype(np.int32)),
                 pa.array([ints[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])], pa.binary())],
                names=["vec_id", "dim", "v"])
    return run


def _blocks(most: int, kind: str):
    """Vectors of one dimension and block packed into rows of at most ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}

        def row(key: tuple[int, int], ids: list, vs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary())],
                names=["dim", "block", f"{kind}_ids", f"{kind}_v"])

        for b in batches:
            for i, d, v, block in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "v", "block"))):
                ids, vs = held.setdefault((d, block), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == most:
                    yield row((d, block), *held.pop((d, block)))
        for key, (ids, vs) in held.items():
            yield row(key, ids, vs)
    return run


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with some candidates."""
    biggest = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, len(q))
    if biggest < 1 << 53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return c @ q


class Best:
    """The k best (score, smaller id first) of one query."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def worst(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            keep = score >= self.score[-1]
            score, ids = score[keep], ids[keep]
            if not len(score):
                return
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]


def search_block(best: list[Best], q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
                 pivots: np.ndarray, step: int = STEP) -> int:
    """Update the queries' best by a block of candidates; returns how many
    candidates were evaluated."""
    qf, cf, pf = q.astype(np.float64), c.astype(np.float64), pivots.astype(np.float64)

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - pf[None, :, :]) ** 2).sum(axis=2)) if len(pf) else np.zeros((len(x), 0))

    to_q = distances(qf)
    to_c = np.concatenate([distances(cf[a:a + 256]) for a in range(0, len(cf), 256)])
    c2, evaluated = (cf * cf).sum(axis=1), 0
    for k in range(len(q)):
        low = np.abs(to_c - to_q[k]).max(axis=1, initial=0.0)
        bound = ((qf[k] @ qf[k]) + c2 - low * low) / 2
        bound += 1e-9 * (np.abs(bound) + c2 + qf[k] @ qf[k]) + 1  # rounding can't hide a candidate
        order = np.argsort(-bound)
        at, size = 0, step
        while at < len(order) and bound[order[at]] >= best[k].worst():
            some = order[at:at + size]
            some = some[bound[some] >= best[k].worst()]
            some = some[c_ids[some] != q_ids[k]]
            best[k].add(exact_scores(q[k], c[some]), c_ids[some])
            evaluated += len(some)
            at, size = at + size, size * 2
    return evaluated


def _search(pivots, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, q_ids, q = None, [], None, None

        def done() -> pa.RecordBatch:
            n = [len(x.ids) for x in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([x.ids for x in best] or [q_ids[:0]])),
                 pa.array(np.concatenate([x.score for x in best] or [q_ids[:0]]))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                dim, key = row.column("dim")[0].as_py(), row.column("block")[0].as_py()
                if key != now:
                    if now is not None:
                        yield done()
                    now = key
                    q_ids = np.frombuffer(row.column("query_ids")[0].as_py(), np.int64)
                    q = _matrix(row.column("query_v"), dim)
                    best = [Best(k) for _ in q_ids]
                c_ids = np.frombuffer(row.column("item_ids")[0].as_py(), np.int64)
                p = np.array([x for x in pivots.value if len(x) == dim], np.int64).reshape(-1, dim)
                search_block(best, q_ids, q, c_ids, _matrix(row.column("item_v"), dim), p)
        if now is not None:
            yield done()
    return run


def topk_search(table: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS,
                queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows of ``table(vec_id,
    embedding)`` for which ``is_query`` (an expression of ``vec_id``) holds."""
    spark = table.sparkSession
    good = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        usable() & F.col("vec_id").isNotNull())
    one = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    items = scratch_table(one.mapInArrow(_integers(scale), "vec_id long, dim int, v binary"))
    chosen = items.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(pivots).select("v")
    shared = spark.sparkContext.broadcast([np.frombuffer(r["v"], np.int64) for r in chosen.toLocalIterator()])

    # query blocks of each dimension, and splits of the candidates, so that no
    # task holds all of either
    splits = max(8, items.count() // (8 * candidates))
    wanted = items.where(is_query)
    n_blocks = scratch_table(wanted.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("n_blocks")))
    asked = (wanted.join(n_blocks, "dim")
             .withColumn("block", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("n_blocks")).cast("int"))
             .repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id")
             .select("vec_id", "dim", "v", "block")
             .mapInArrow(_blocks(2 * queries, "query"), "dim int, block int, query_ids binary, query_v binary")
             .withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))))
    packed = (items.withColumn("block", F.lit(0))
              .mapInArrow(_blocks(candidates, "item"), "dim int, block int, item_ids binary, item_v binary")
              .withColumn("split", F.pmod(F.xxhash64("item_ids"), F.lit(splits)).cast("int"))
              .join(n_blocks, "dim")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))))
    met = (packed.join(asked, ["dim", "block", "split"])
           .withColumn("part", F.xxhash64("query_ids")).sortWithinPartitions("dim", "block", "split", "part"))
    found = met.select("dim", F.xxhash64("dim", "block", "split", "part").alias("block"), "query_ids", "query_v",
                       "item_ids", "item_v").mapInArrow(
        _search(shared, k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
