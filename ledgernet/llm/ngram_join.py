"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles (words ``[^\\x20\\x09-\\x0D]+``; a
shorter text with words is one shingle).  Links are pairs with Jaccard
similarity of 0.8 or more.

1. Equal sets form a class, represented by its smallest ``doc_id``.
2. A class is embedded as ``COORDS`` min-hashes (token = coordinate, value).
   In each of ``RUNS`` runs, which has ``TOKENS`` of the min-hashes to itself,
   a set follows the paths of the tokens that its node samples (each with
   probability 1 / (similarity * TOKENS), seeded by the path, so that similar
   sets choose alike).  A bucket of at most ``SMALL`` sets is compared by brute
   force on the sketches; a larger one is split on, up to ``DEPTH`` tokens.  What
   is still large then (near copies, which no token splits) is a large group, as
   are large buckets that share sets.
3. Pairs of small buckets whose sketches and sizes allow the similarity are
   verified as pairs, each once and exactly on the shingle sets.  Their
   components only say which sets travel together, and blocks which pairs of a
   large component; no pair is formed by closure.  Pairs inside a large group
   are all verified, in blocks (``pair_blocks``) that return counts and local
   components, not a row per pair.  A set of which less than the similarity
   stands in other sets of its group (by a count-min sketch, which overestimates)
   links with none of them and is left out, as are shingles of one set only.

A pair at the threshold is lost if no run brings it into one bucket (``miss``;
at 0.8, ``DEPTH`` tokens deep, 1.6e-7; one token deep 5e-11) or if its sketches
agree too little (``least_agreement``: below ``SKETCH_MISS``; at 0.8, fewer than
34 of 64, 3.2e-7): in all less than 1e-6.  Nothing found is below the threshold.

Defined results: null or blank texts link with nothing; rows that share a
``doc_id`` are one document (the smallest set digest stands for it); a null
``doc_id`` gets a row of its own with no class; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm import rolling, sketch
from ledgernet.llm.common import NO_ID, group_batches, keyed_text, steps, text_buffer
from ledgernet.llm.components import components
from ledgernet.llm.pair_blocks import block_pairs, sides
from ledgernet.session import scratch_table

U = np.uint64
SHINGLE, SIMILARITY = 5, 0.8
COORDS, RUNS, DEPTH, SMALL = 64, 12, 3, 200
#: Min-hashes of each run's own (RUNS * TOKENS <= COORDS); the low bits of a
#: path name its run.
TOKENS, RUN_BITS = 5, 4
#: Chance that a pair at the threshold agrees in too few coordinates.
SKETCH_MISS = 5e-7
#: Sets and shingles of a verification block.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_500_000
#: Rows of a block that are compared at a time.
PART_ROWS = 256

_A = (rolling.mix(np.arange(1, COORDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1))
_B = rolling.mix(np.arange(1001, COORDS + 1001, dtype=U)).astype(np.uint32)


def _binomial(n: int, p: float) -> list[float]:
    return [comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]


def least_agreement(similarity: float) -> int:
    """Sketch agreement (of COORDS) from which two sets become candidates."""
    below, chances = 0.0, _binomial(COORDS, similarity)
    for k, chance in enumerate(chances):
        below += chance
        if below > SKETCH_MISS:
            return max(k, 1)
    return COORDS


def miss(similarity: float, runs: int = RUNS, depth: int = DEPTH) -> float:
    """Chance that no run brings a pair into one bucket of ``depth`` tokens."""
    share, one = min(1.0, 1 / (similarity * TOKENS)), 0.0
    for same, chance in enumerate(_binomial(TOKENS, similarity)):
        found = 1.0
        for _ in range(depth):
            # none of the sampled tokens leads there, or none is sampled and the stand-in doesn't
            found = 1 - (1 - share * found) ** same + (1 - share) ** TOKENS * same / TOKENS * found
        one += chance * (1 - found)
    return one ** runs


def shingle_sets(column: pa.Array, n: int):
    """``(rows, sets)``: for each row with words its sorted shingle hashes."""
    buf, offsets = text_buffer(column)
    for i, j in steps(offsets):
        start, end, bounds = rolling.word_spans(buf, offsets[i:j + 1])
        count = np.diff(bounds)
        if not len(start):
            continue
        prefix = rolling.poly(0).prefix(rolling.word_hashes(buf, start, end))
        first = np.arange(len(start))
        last = np.minimum(first + n, np.repeat(bounds[1:], count))
        h = rolling.mix(rolling.poly(0).span(prefix, first, last) ^ (last - first).astype(U))
        rows, sets = [], []
        for k in np.flatnonzero(count):
            a, z = int(bounds[k]), int(bounds[k + 1])
            rows.append(i + int(k))
            sets.append(np.unique(h[a:max(a + 1, z - n + 1)]))
        yield rows, sets


def _embed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sets in shingle_sets(b.column("text"), n):
                flat = np.concatenate(sets)
                size = np.array([len(s) for s in sets], np.int64)
                cut = np.cumsum(size) - size
                low = (flat >> U(32)).astype(np.uint32)
                sig = np.empty((len(sets), COORDS), np.uint32)
                for c in range(COORDS):
                    sig[:, c] = np.minimum.reduceat((low ^ _B[c]) * _A[c], cut)
                s1 = np.add.reduceat(rolling.mix(flat), cut)
                s2 = np.add.reduceat(rolling.mix(flat ^ U(0x5851F42D4C957F2D)), cut)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("dk").take(at), pa.array(size),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "dk", "n", "s1", "s2", "sig"])
    return run


def _signatures(column: pa.Array, kind=np.uint32) -> np.ndarray:
    buf, offsets = text_buffer(column)
    return buf[int(offsets[0]):int(offsets[-1])].view(np.uint8).copy().view(kind).reshape(-1, COORDS)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, sketch``: the low half of each min-hash, enough to compare."""
    for b in batches:
        low = _signatures(b.column("sig")).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array([s.tobytes() for s in low], pa.binary())],
                                         names=["node", "n", "sketch"])


def _follow(similarity: float, runs: int, root: bool):
    """Child paths of every (path, set); at the root, of every run."""
    if runs * TOKENS > COORDS:
        raise ValueError(f"{runs} runs need {runs * TOKENS} min-hashes of their own, there are {COORDS}")
    share = U(int((1 << 64) * min(1.0, 1 / (similarity * TOKENS)) * (1 - 2.0 ** -52)))
    coord = rolling.mix(np.arange(COORDS, dtype=U) + U(77))
    low = U((1 << RUN_BITS) - 1)

    def children(paths: np.ndarray, sig: np.ndarray):
        own = (paths & low).astype(np.int64)[:, None] * TOKENS + np.arange(TOKENS)
        draw = rolling.mix(paths[:, None] ^ coord[own])
        chosen = draw < share
        none = np.flatnonzero(~chosen.any(axis=1))
        chosen[none, draw[none].argmin(axis=1)] = True
        at, k = np.nonzero(chosen)
        child = rolling.mix(draw[at, k] + U(1) + sig[at, own[at, k]].astype(U) * U(0x9E3779B97F4A7C15))
        return at, (child & ~low) | (paths[at] & low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = _signatures(part.column("sig"))
                if root:
                    seeds = rolling.mix(np.arange(1, runs + 1, dtype=U) * U(0xD1342543DE82EF95))
                    starts = [np.full(len(sig), (seeds[r] & ~low) | U(r), U) for r in range(runs)]
                else:
                    starts = [part.column("path").to_numpy().view(U)]
                for paths in starts:
                    who, child = children(paths, sig)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(child.view(np.int64)), part.column("node").take(pa.array(who))],
                        names=["path", "node"])
    return run


def _compare_buckets(least: int, similarity: float):
    """Pairs ``a < b`` of each small bucket that sketches and sizes allow and
    that no large group holds."""
    limit = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "path"):
            t = t.combine_chunks()
            path, node, n, large = (t.column(c).to_numpy() for c in ("path", "node", "n", "large"))
            sig = _signatures(t.column("sketch").combine_chunks() if t.column("sketch").num_chunks != 1
                              else t.column("sketch").chunk(0), np.uint16)
            cut = np.flatnonzero(np.insert(path[1:] != path[:-1], 0, True))
            size = np.diff(np.append(cut, len(path)))
            two = cut[size == 2]
            left, right = [two], [two + 1]
            for c, m in zip(cut[size > 2], size[size > 2]):
                x, y = np.triu_indices(m, 1)
                left.append(c + x)
                right.append(c + y)
                if sum(map(len, left)) > 1 << 16:
                    yield _allowed(np.concatenate(left), np.concatenate(right), node, n, large, sig, least, limit)
                    left, right = [], []
            if left:
                yield _allowed(np.concatenate(left), np.concatenate(right), node, n, large, sig, least, limit)
    return run


def _allowed(x, y, node, n, large, sig, least: int, limit: Fraction) -> pa.RecordBatch:
    keep = np.minimum(n[x], n[y]) * limit.denominator >= np.maximum(n[x], n[y]) * limit.numerator
    keep &= (large[x] != large[y]) | (large[x] < 0)
    x, y = x[keep], y[keep]
    agree = np.concatenate([(sig[x[k:k + 4096]] == sig[y[k:k + 4096]]).sum(axis=1) for k in range(0, len(x), 4096)]
                           or [np.zeros(0, np.int64)]) >= least
    a, b = node[x[agree]], node[y[agree]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def by_membership(rows: DataFrame, columns: list[str], of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key ``columns`` may be among the table ``of``'s, and the others,
    whose keys are not: these need no join."""
    h = F.xxhash64(*columns).alias("__h")
    wanted = rows.sparkSession.sparkContext.broadcast(sketch.members(of.select(h), "__h", of.count()))

    def chosen(member: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            may = wanted.value
            for b in batches:
                at = np.flatnonzero(may(b.column("__h").to_numpy().view(U)) == member)
                yield b.take(pa.array(at)).select(b.schema.names[:-1])
        return rows.select("*", h).mapInArrow(run, rows.schema)
    return chosen(True), chosen(False)


def only_members(rows: DataFrame, columns: list[str], of: DataFrame) -> DataFrame:
    """``rows`` whose key ``columns`` may be among the table ``of``'s, before a
    join that drops the others: those are not shuffled."""
    return by_membership(rows, columns, of)[0]


def candidates(sets: DataFrame, similarity: float = SIMILARITY, runs: int = RUNS, depth: int = DEPTH,
               small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """``sets(node, n, sig)`` → pairs ``a < b`` to verify, and the large groups
    ``node, component`` of which all pairs are to be verified (None: there are none)."""
    least = least_agreement(similarity)
    paths = sets.mapInArrow(_follow(similarity, runs, root=True), "path long, node long")
    sigs = sets.select("node", "sig")
    buckets, stars = None, None
    for level in range(1, depth + 1):
        # one set may reach a bucket once only
        paths = scratch_table(paths)
        sizes = scratch_table(paths.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1"))
        paths = only_members(paths, ["path"], sizes)  # most paths have one set
        leaves = paths.join(sizes.where(F.col("size") <= small).select("path"), "path").select("path", "node")
        buckets = leaves if buckets is None else buckets.unionAll(leaves)
        large = sizes.where(F.col("size") > small)
        if large.isEmpty():
            break
        rest = paths.join(large.select("path", "least"), "path")
        if level == depth:
            stars = rest.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
        else:
            rest = scratch_table(rest.select("path", "node"))
            paths = rest.join(only_members(sigs, ["node"], rest), "node").select("path", "node", "sig").mapInArrow(
                _follow(similarity, runs, root=False), "path long, node long").distinct()
    groups = None if stars is None else components(stars)
    buckets = scratch_table(buckets)
    short = only_members(sets.select("node", "n", "sig"), ["node"], buckets).mapInArrow(
        _short, "node long, n long, sketch binary")
    if groups is None:
        marked = short.withColumn("large", F.lit(-1).cast("long"))
    else:
        marked = short.join(groups.withColumnRenamed("component", "large"), "node", "left").withColumn(
            "large", F.coalesce("large", F.lit(-1).cast("long")))
    pairs = (buckets.join(marked, "node").select("path", "node", "n", "large", "sketch")
             .repartition("path").sortWithinPartitions("path")
             .mapInArrow(_compare_buckets(least, similarity), "a long, b long").distinct())
    return scratch_table(pairs), groups


def _in_group(sets: list[np.ndarray], grp: np.ndarray) -> np.ndarray:
    """The sets' shingles, end to end, as hashes of (group, shingle)."""
    flat = np.concatenate(sets)
    return rolling.mix(flat ^ np.repeat(rolling.mix(grp.view(U)), [len(s) for s in sets]))


def _group_shingles(n: int):
    def run(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        grp = b.column("grp").to_numpy()
        for rows, sets in shingle_sets(b.column("text"), n):
            yield _in_group(sets, grp[rows])
    return run


def _with_partners(similarity: float, n: int, shared):
    """Rows whose set may have a similar one in its group: at least ``similarity`` of
    a set is in such a one, so stands twice in the group."""
    limit = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = shared.value
        for b in batches:
            grp = b.column("grp").to_numpy()
            for rows, sets in shingle_sets(b.column("text"), n):
                size = np.array([len(s) for s in sets], np.int64)
                twice = np.add.reduceat(may(_in_group(sets, grp[rows])).astype(np.int64), np.cumsum(size) - size)
                stay = np.array(rows)[twice * limit.denominator >= size * limit.numerator]
                if len(stay):
                    yield b.take(pa.array(stay))
    return run


def _pack(n: int, shared=None):
    """Of each block of texts (sorted by ``key``) a row: ``node``, ``copies`` and
    ``size`` of its sets, and of the sets themselves what ``shared`` may hold (no other
    set of the group has the rest), ``held`` shingles each, compressed: near copies, which
    share most of what they hold, stand next to each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "key", least_rows=1, least_bytes=1):
            t = t.combine_chunks()
            key = t.column("key").to_numpy()
            cut = np.append(np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True)), len(key))
            for a, z in zip(cut[:-1], cut[1:]):
                rows = t.slice(a, z - a)
                at, sets = [], []
                for some, found in shingle_sets(rows.column("text").combine_chunks(), n):
                    at += some
                    sets += found
                order = np.argsort([s[0] for s in sets], kind="stable")  # near copies next to each other
                at, sets = np.array(at)[order], [sets[k] for k in order]
                size = held = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                if shared is not None:
                    keep = shared.value(_in_group(sets, rows.column("grp").to_numpy()[at]))
                    flat, held = flat[keep], np.add.reduceat(keep.astype(np.int64), np.cumsum(size) - size)
                named = [rows.column(c).to_numpy()[at].tobytes() for c in ("node", "copies")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).slice(0, 1).combine_chunks() for c in ("grp", "block", "n_blocks")]
                    + [pa.array([x], pa.binary()) for x in (*named, size.tobytes(), held.tobytes(),
                                                            pa.compress(flat, "zstd", asbytes=True))],
                    names=["grp", "block", "n_blocks", "node", "copies", "size", "held", "body"])
    return run


def intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``rows`` x ``cols``, by bit maps over
    the values that at least two sets hold."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = (np.cumsum(shared) - 1).astype(np.int32)[at]
    keep = shared[at]
    of, place = of[keep], place[keep]
    wide = int(shared.sum())
    del flat, values, at, count, shared, keep
    out = np.zeros((len(rows), len(cols)), np.int32)
    chunk = 8192
    by = np.argsort(place // chunk, kind="stable")
    of, place = of[by], place[by]
    cuts = np.searchsorted(place // chunk, np.arange(wide // chunk + 2))
    for c, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a == z:
            continue
        held = min(chunk, -(-int(place[a:z].max() - c * chunk + 1) // 64) * 64)
        bits = np.zeros((len(sets), held), bool)
        bits[of[a:z], place[a:z] - c * chunk] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        left, right = words[rows], words[cols]
        for k in np.flatnonzero(left.any(axis=1)):
            out[k] += np.bitwise_count(left[k] & right).sum(axis=1, dtype=np.int32)
    return out


def _verify(similarity: float):
    """Similar pairs between the two blocks (or inside the block) of each key."""
    limit = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "pair", least_rows=1, least_bytes=1):
            pair = t.column("pair").to_numpy()
            cut = np.append(np.flatnonzero(np.insert(pair[1:] != pair[:-1], 0, True)), len(pair))
            for a, z in zip(cut[:-1], cut[1:]):
                sets, named = [], {"side": [], "node": [], "copies": [], "size": []}
                for row in t.slice(a, z - a).to_pylist():
                    held = np.frombuffer(row["held"], np.int64)
                    flat = np.frombuffer(pa.decompress(row["body"], 8 * int(held.sum()), "zstd", asbytes=True), U)
                    sets += np.split(flat, np.cumsum(held)[:-1])
                    named["side"].append(np.full(len(held), row["side"]))
                    for c in ("node", "copies", "size"):
                        named[c].append(np.frombuffer(row[c], np.int64))
                side, node, copies, size = (np.concatenate(x) for x in named.values())
                own, cols, same = sides(side)
                if not len(own) or not len(cols):
                    continue
                n, root = np.zeros(len(node), np.int64), node.copy()
                inter = intersections(sets, own, cols)
                for start in range(0, len(own), PART_ROWS):
                    some = own[start:start + PART_ROWS]
                    # of sizes s and t, i in common: i / (s + t - i) >= p / q
                    full = (inter[start:start + PART_ROWS].astype(np.int64) * (limit.denominator + limit.numerator)
                            >= (size[some][:, None] + size[cols][None, :]) * limit.numerator)
                    if same:
                        full[np.arange(len(some)), some] = False
                    for k in np.flatnonzero(full.any(axis=1)):
                        links = cols[full[k]]
                        n[some[k]] += copies[links].sum()
                        if not same:
                            n[links] += copies[some[k]]
                        labels = np.append(root[links], root[some[k]])
                        least = labels.min()
                        for label in np.unique(labels[labels != least]):
                            root[root == label] = least
                linked = n > 0
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[linked]) for x in (node, n, root)], names=["node", "n", "root"])
    return run


def _verify_pairs(similarity: float, n: int):
    """Of each key's texts (side 0) and pairs (side 1: ``node``, ``other``) the
    pairs that are similar, from both ends."""
    limit = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "pair", least_rows=4096, least_bytes=8 << 20):
            t = t.combine_chunks()
            pair, side = t.column("pair").to_numpy(), t.column("side").to_numpy()
            node, other, copies = (t.column(c).to_numpy() for c in ("node", "other", "copies"))
            text = t.column("text")
            sets: dict[int, np.ndarray] = {}
            for some, found in shingle_sets(text.combine_chunks() if text.num_chunks != 1 else text.chunk(0), n):
                sets.update(zip(some, found))
            cut = np.append(np.flatnonzero(np.insert(pair[1:] != pair[:-1], 0, True)), len(pair))
            out: list[list[int]] = [[], [], []]
            for a, z in zip(cut[:-1], cut[1:]):
                held = a + int((side[a:z] == 0).sum())
                at = {int(node[k]): k for k in range(a, held)}
                for k in range(held, z):
                    x, y = at.get(int(node[k])), at.get(int(other[k]))
                    if x is None or y is None:
                        continue
                    few, many = sorted((sets[x], sets[y]), key=len)
                    places = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    inter = int((many[places] == few).sum())
                    if inter * limit.denominator >= (len(few) + len(many) - inter) * limit.numerator:
                        out[0] += [int(node[x]), int(node[y])]
                        out[1] += [int(copies[y]), int(copies[x])]
                        out[2] += [int(min(node[x], node[y]))] * 2
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["node", "n", "root"])
    return run


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, runs: int = RUNS,
               depth: int = DEPTH, small: int = SMALL, block_sets: int = BLOCK_SETS,
               block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id reachable by
    links), ``n_links`` (other documents linked directly, copies included) and
    ``kept`` (``doc_id = class_id``)."""
    rows = keyed_text(docs)
    ids = F.col("doc_id") != NO_ID
    found = rows.where(ids & F.col("text").isNotNull()).mapInArrow(
        _embed(shingle), "doc_id long, dk long, n long, s1 long, s2 long, sig binary")
    sets = scratch_table(found)
    if sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        one = sets
    else:
        one = scratch_table(sets.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n", "dk", "sig")).alias("x"))
                            .select("doc_id", "x.*"))
    classes = scratch_table(
        one.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "dk")).alias("x"),
                                         F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
        .select(F.col("x.doc_id").alias("node"), "x.dk", "s1", "s2", "n", "copies", "sig"))

    pairs, groups = candidates(classes.select("node", "n", "sig"), similarity, runs, depth, small)
    texts = rows.where(ids & F.col("text").isNotNull()).select(F.col("doc_id").alias("node"), "dk", "text")
    own = classes.select("node", "dk", "n", "copies")

    def with_texts(placed: DataFrame) -> DataFrame:
        """Rows ``node, dk, ..`` with the text; only members' texts move."""
        placed = scratch_table(placed)
        found = only_members(texts, ["node", "dk"], placed)
        return placed.join(found if one is sets else found.dropDuplicates(["node", "dk"]), ["node", "dk"])

    def in_blocks(members: DataFrame) -> DataFrame:
        """Members ``node, grp, n`` with the blocks of their group."""
        return members.join(members.groupBy("grp").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_shingles),
                       F.lit(1)).cast("int").alias("n_blocks")), "grp")

    # pairs of small buckets: a component's sets travel together, cut by blocks
    members = in_blocks(scratch_table(components(pairs).withColumnRenamed("component", "grp").join(own, "node")))
    block = F.pmod(F.xxhash64(F.lit(17), "node"), F.col("n_blocks")).alias("block")
    ends = members.select("node", "grp", block)
    keyed = scratch_table(
        pairs.join(ends.withColumnsRenamed({"node": "a", "block": "block_a"}), "a")
        .join(ends.drop("grp").withColumnsRenamed({"node": "b", "block": "block_b"}), "b")
        .select("a", "b", F.xxhash64(F.lit(31), "grp", F.least("block_a", "block_b"),
                                     F.greatest("block_a", "block_b")).alias("pair")))
    needed = keyed.select("pair", F.explode(F.array("a", "b")).alias("node")).distinct().join(own.drop("n"), "node")
    none = F.lit(None)
    listed = (with_texts(needed).select("pair", F.lit(0).alias("side"), "node", F.lit(0).cast("long").alias("other"),
                                        "copies", "text")
              .unionByName(keyed.select("pair", F.lit(1).alias("side"), F.col("a").alias("node"), F.col("b").alias("other"),
                                        F.lit(0).cast("long").alias("copies"), none.cast("string").alias("text")))
              .repartition("pair").sortWithinPartitions("pair", "side")
              .mapInArrow(_verify_pairs(similarity, shingle), "node long, n long, root long"))
    if groups is not None:  # all pairs of large groups
        crowd = scratch_table(with_texts(groups.withColumnRenamed("component", "grp").join(own, "node")))
        # most sets of a group may have only a common passage: what no other set has isn't
        # compared, nor a set of too much of it
        twice = rows.sparkSession.sparkContext.broadcast(sketch.repeated(
            crowd.select("grp", "text"), _group_shingles(shingle), crowd.agg(F.sum("n")).first()[0] or 0))
        crowd = in_blocks(scratch_table(crowd.mapInArrow(_with_partners(similarity, shingle, twice), crowd.schema)))
        blocks = scratch_table(
            crowd.withColumn("block", block.cast("int")).withColumn("key", F.xxhash64(F.lit(23), "grp", "block"))
            .select("key", "grp", "block", "n_blocks", "node", "copies", "text").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_pack(shingle, twice), "grp long, block int, n_blocks int, node binary, copies binary, size binary, "
                        "held binary, body binary"))
        listed = listed.unionByName(
            block_pairs(blocks, "grp", "block", "n_blocks", own="block")
            .select("pair", "side", "node", "copies", "size", "held", "body").repartition("pair").sortWithinPartitions("pair")
            .mapInArrow(_verify(similarity), "node long, n long, root long"))
    verified = scratch_table(listed)
    linked = verified.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = (classes.select("node", "s1", "s2", "n", "copies")
             .join(linked.withColumnRenamed("n", "others"), "node", "left")
             .join(joined, "node", "left")
             .select("s1", "s2", "n", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("class_id")))
    marked = one.select("doc_id", "s1", "s2", "n").join(label, ["s1", "s2", "n"]).select(
        "doc_id", "class_id", "n_links")
    named = rows.select("doc_id").where(ids).distinct().join(marked, "doc_id", "left")
    nameless = rows.where(~ids).select(F.lit(None).cast("long").alias("doc_id"),
                                       F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_links"))
    return (named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links").unionAll(nameless)
            .select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")))
