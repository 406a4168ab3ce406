"""Embedding near-dedup with a pivot-permutation index.

Each vector is described by its ``nearest`` nearest reference points, in
order.  The index is one inverted list per label and pivot; two vectors are
candidates when they share at least ``shared`` pivots, and a candidate pair is
verified by its cosine in double precision, in the list of the smallest pivot
that both have, so once.  Long lists are compared in blocks (``pair_blocks``),
which return link counts and local components instead of pairs.

The index is fitted on a bounded sample: the pivots are ``n / PER_PIVOT``
vectors (between ``MIN_PIVOTS`` and ``MAX_PIVOTS``), those with the smallest
hashes of their ids, and only they are broadcast (at most ``MAX_PIVOTS`` times
a vector).  Every vector is indexed.

Defined results: a null label, and a vector that is null, empty, zero or holds
null or non-finite components, link with nothing; vectors of different lengths
don't link; rows that share a ``vec_id`` are one vector (the smallest label and
vector stand for it); a null ``vec_id`` gets a row with no links and no
component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.common import group_batches, text_buffer
from ledgernet.llm.components import components
from ledgernet.llm.pair_blocks import block_pairs, local_roots, sides
from ledgernet.session import scratch_table

COSINE = 0.98
MIN_PIVOTS, MAX_PIVOTS, PER_PIVOT = 32, 2048, 96
NEAREST, SHARED = 8, 2
#: Vectors of a block.
BLOCK = 512


def usable(column: str = "embedding"):
    """Not null, not empty, not zero, all components finite numbers."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(column)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0),
                      F.lit(False))


def vectors(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as double arrays."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(offsets[:-1], offsets[1:])]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by the largest component first (no overflow)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _index(pivots, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots.value
        for b in batches:
            rows = vectors(b.column("embedding"))
            length = np.array([len(r) for r in rows])
            for d in np.unique(length):
                at = np.flatnonzero(length == d)
                x = unit(np.stack([rows[k] for k in at]))
                p = np.zeros((len(refs), d))
                for k, r in enumerate(refs):
                    p[k, :min(d, len(r))] = r[:d]
                k = min(nearest, len(refs))
                near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k].astype(np.int32)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(take), b.column("label").take(take), pa.array(np.full(len(at), d, np.int32)),
                     pa.array(near.tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["vec_id", "label", "dim", "near", "unit"])
    return run


def _verify(cosine: float, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "pair", least_rows=4096):
            t = t.combine_chunks()
            one = lambda name: t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)
            pair, side, ids = (t.column(c).to_numpy() for c in ("pair", "side", "vec_id"))
            pivot, dim = t.column("pivot").to_numpy(), t.column("dim").to_numpy()
            near = np.stack(one("near").to_numpy(zero_copy_only=False))
            buf, offsets = text_buffer(one("unit"))
            cut = np.append(np.flatnonzero(np.insert(pair[1:] != pair[:-1], 0, True)), len(pair))
            out: list[list[np.ndarray]] = [[], [], []]
            for a, z in zip(cut[:-1], cut[1:]):
                if z - a < 2:
                    continue
                x = buf[offsets[a]:offsets[z]].copy().view(np.float64).reshape(z - a, int(dim[a]))
                own, cols, same = sides(side[a:z])
                if not len(own) or not len(cols):
                    continue
                i, j = np.nonzero(x[own] @ x[cols].T >= cosine)
                i, j = own[i], cols[j]
                keep = (i < j) if same else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                full = np.zeros((z - a, z - a), bool)
                for s in range(0, len(i), 65_536):
                    u, v = i[s:s + 65_536], j[s:s + 65_536]
                    both = near[a + u][:, :, None] == near[a + v][:, None, :]
                    common = both.any(axis=2)
                    least = np.where(common, near[a + u], 1 << 30).min(axis=1)
                    ok = (common.sum(axis=1) >= min(shared, near.shape[1])) & (least == pivot[a])
                    full[u[ok], v[ok]] = True
                full |= full.T
                linked = full.any(axis=1)
                if linked.any():
                    out[0].append(ids[a:z][linked])
                    out[1].append(full.sum(axis=1)[linked])
                    out[2].append(local_roots(full, ids[a:z])[linked])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out],
                                                 names=["node", "n", "root"])
    return run


def embedding_dedup(table: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED,
                    block: int = BLOCK) -> DataFrame:
    """One row per vector of ``table(vec_id, embedding, label)``: ``vec_id,
    n_links, component_id, kept``."""
    spark = table.sparkSession
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = rows.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = scratch_table(good.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x"))
                         .select("vec_id", "x.label", "x.embedding"))
    n = good.count()
    m = min(MAX_PIVOTS, max(MIN_PIVOTS, n // PER_PIVOT))
    sample = good.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(m).select("embedding")
    pivots = [unit(np.array([r[0]], np.float64))[0] for r in sample.toLocalIterator()]
    if not pivots:
        links = None
    else:
        indexed = scratch_table(good.mapInArrow(
            _index(spark.sparkContext.broadcast(pivots), nearest),
            f"vec_id long, label {dict(good.dtypes)['label']}, dim int, near array<int>, unit binary"))
        posted = indexed.withColumn("pivot", F.explode("near")).withColumn(
            "lst", F.xxhash64(F.lit(3), F.col("label"), F.col("dim"), F.col("pivot")))
        sizes = posted.groupBy("lst").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
        paired = block_pairs(posted.join(sizes, "lst"), "lst", "vec_id", "n_blocks")
        links = scratch_table(paired.select("pair", "side", "vec_id", "pivot", "dim", "near", "unit")
                              .repartition("pair").sortWithinPartitions("pair")
                              .mapInArrow(_verify(cosine, shared), "node long, n long, root long"))
    base = rows.select("vec_id").where("vec_id IS NOT NULL").distinct()
    if links is None:
        found = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        count = links.groupBy(F.col("node").alias("vec_id")).agg(F.sum("n").alias("n"))
        comp = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
        found = (base.join(count, "vec_id", "left").join(comp, "vec_id", "left")
                 .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component", "vec_id").alias("component_id")))
    nameless = rows.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                   F.lit(None).cast("long").alias("component_id"))
    return found.unionAll(nameless).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
