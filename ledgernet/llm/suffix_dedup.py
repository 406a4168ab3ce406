"""Suffix-array dedup: remove bytes covered by 400-byte strings that repeat.

All suffixes of a corpus can't be sorted at scale, and need not be: a repeated
400-byte string has the same content-chosen anchor (see ``rolling``) at each
of its starts, so only the suffixes at anchors are sorted, and what stands
left of an anchor is compared as a reversed suffix.

1. A count-min sketch of all anchors (``sketch``) says which may repeat; the
   other segments of windows hold no repeated string.
2. Equal segments are counted as one (map-side first).  A segment that occurs
   twice is repeated throughout.
3. Segments that share an anchor but differ are sorted as suffixes at their
   anchors: a mergesort whose comparisons find the common extension of two
   suffixes by binary search on polynomial prefix hashes.  Neighbours' common
   extensions are then verified byte by byte; if a hash collision misplaced a
   suffix, the sort is repeated by byte order.  Going left, each set of
   suffixes is split where its members' common left extension ends, and every
   suffix takes the best right extension it has within its set.
4. Anchors with more than ``HOT`` different segments would make one large
   task: their windows are counted by 128-bit hashes over all tasks instead,
   with the same result.

Defined results: null text is empty; a text of under 400 bytes stays; rows
with equal ids or texts are separate places, so repeated rows remove each
other; a null ``doc_id`` counts like any other id; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm import rolling
from ledgernet.llm.common import group_batches, keyed_text, ranges, steps, text_buffer, with_spans
from ledgernet.llm.sketch import repeated
from ledgernet.session import scratch_table

#: Bytes of a window and of an anchor string inside it.
WINDOW, GRAM = 400, 100
#: Most different segments of one anchor that are sorted in one task.
HOT = 4096


def _segments(column: pa.Array, window: int, gram: int):
    buf, offsets = text_buffer(column)
    value = rolling.poly(0).table
    for i, j in steps(offsets):
        for seg, lo, row in rolling.segment_runs(lambda a, z: value[buf[a:z]], offsets[i:j + 1], window, gram):
            yield i + row, offsets, seg, lo


def _anchor_hashes(window: int, gram: int):
    def run(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, seg, _ in _segments(b.column("text"), window, gram):
            yield seg.key
    return run


def _suspects(window: int, gram: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = sketch.value
        for b in batches:
            ids, dks = b.column("doc_id"), b.column("dk")
            for row, offsets, seg, lo in _segments(b.column("text"), window, gram):
                only = np.flatnonzero(maybe(seg.key))
                if not len(only):
                    continue
                s1, s2 = seg.content(only)
                at = seg.seq[only] + row
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), dks.take(pa.array(at)),
                    pa.array(seg.first[only] + lo - offsets[at]), pa.array(seg.count[only].astype(np.int32)),
                    pa.array((seg.anchor[only] - seg.first[only]).astype(np.int32)),
                    pa.array(seg.key[only].view(np.int64)),
                    pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                ], names=["doc_id", "dk", "first", "n", "left", "kh", "s1", "s2"])
    return run


_SUSPECT = "doc_id long, dk long, first long, n int, left int, kh long, s1 long, s2 long"


# ------------------------------------------------- suffix order at the anchors

class AnchorSuffixes:
    """Suffixes at anchors in some short strings laid end to end.

    ``at``: place of each anchor; ``left`` / ``right``: bytes of its string
    before / from it on."""

    def __init__(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.data, self.at, self.left, self.right = data, at, left, right
        self.poly = rolling.poly(0)
        self.p = self.poly.prefix(self.poly.table[data])

    def common(self, i: np.ndarray, j: np.ndarray, leftward: bool = False) -> np.ndarray:
        """Bytes that suffixes i and j have in common, by binary search on the
        prefix hashes."""
        room = self.left if leftward else self.right
        lo = np.zeros(len(i), np.int64)
        hi = np.minimum(room[i], room[j]).astype(np.int64)
        a, b = self.at[i], self.at[j]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            if leftward:
                same = self.poly.span(self.p, a - mid, a) == self.poly.span(self.p, b - mid, b)
            else:
                same = self.poly.span(self.p, a, a + mid) == self.poly.span(self.p, b, b + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def checked(self, i: np.ndarray, j: np.ndarray, leftward: bool = False) -> np.ndarray:
        """``common``, verified on the bytes; a collision's excess is cut."""
        if len(i) > 512:  # bounds the bytes that are compared at a time
            return np.concatenate([self.checked(i[k:k + 512], j[k:k + 512], leftward) for k in range(0, len(i), 512)])
        n = self.common(i, j, leftward)
        if not n.sum():
            return n
        step = -1 if leftward else 1
        shift = -1 if leftward else 0
        k = ranges(np.zeros(len(n), np.int64), n)
        differ = self.data[np.repeat(self.at[i] + shift, n) + step * k] != \
            self.data[np.repeat(self.at[j] + shift, n) + step * k]
        if differ.any():
            pair = np.repeat(np.arange(len(n)), n)[differ]
            np.minimum.at(n, pair, k[differ])
        return n

    def _after(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte of suffix i behind n common ones, -1 at its end."""
        end = n >= self.right[i]
        return np.where(end, -1, self.data[np.minimum(self.at[i] + n, len(self.data) - 1)].astype(np.int64))

    def _less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        x, y = self._after(i, n), self._after(j, n)
        return (x < y) | (or_equal & (x == y))

    def order(self, bounds: np.ndarray) -> np.ndarray:
        """Suffix order within each of the groups that ``bounds`` delimit."""
        n = int(bounds[-1])
        order = np.arange(n)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        start, size = bounds[:-1][group], np.diff(bounds)[group]
        width, most = 1, int(np.diff(bounds).max(initial=0))
        while width < most:
            place = np.arange(n) - start
            run = place // width
            first = run % 2 == 0
            other = np.where(first, run + 1, run - 1) * width
            length = np.clip(size - other, 0, width)
            move = length > 0
            lo, hi = np.zeros(n, np.int64), length.astype(np.int64)
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) >> 1
                theirs = order[start[todo] + other[todo] + mid]
                # equal suffixes: the first run's come first
                below = self._less(theirs, order[todo], ~first[todo])
                lo[todo] = np.where(below, mid + 1, lo[todo])
                hi[todo] = np.where(below, hi[todo], mid)
            new = np.where(move, start + np.minimum(run, run ^ 1) * width + place % width + lo, np.arange(n))
            nxt = np.empty_like(order)
            nxt[new] = order
            order, width = nxt, width * 2
        near = np.flatnonzero(group[1:] == group[:-1])
        if len(near):
            i, j = order[near], order[near + 1]
            n_common = self.checked(i, j)
            if (self._after(i, n_common) > self._after(j, n_common)).any():
                raw = self.data.tobytes()
                order = np.array(sorted(range(n), key=lambda x: (
                    group[x], raw[self.at[x]:self.at[x] + self.right[x]])))
        return order

    def repeated_offsets(self, bounds: np.ndarray, window: int, low: np.ndarray, high: np.ndarray):
        """``(suffix, from, to)``: windows that start ``from``..``to`` bytes
        before the anchor and occur in another string of the group; each
        suffix has windows at ``low``..``high``."""
        members = self.order(bounds)
        node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = []
        depth = np.zeros(0, np.int64)
        while True:
            # members: suffix order within nodes; drop nodes of one
            same = node[1:] == node[:-1]
            alone = ~(np.append(same, False) | np.insert(same, 0, False))
            members, node = members[~alone], node[~alone]
            if not len(members):
                break
            pair = np.flatnonzero(node[1:] == node[:-1])
            i, j = members[pair], members[pair + 1]
            right = self.checked(i, j)
            best = np.zeros(len(members), np.int64)
            best[pair] = right
            best[pair + 1] = np.maximum(best[pair + 1], right)
            left = self.checked(i, j, leftward=True)
            first = np.flatnonzero(np.insert(node[1:] != node[:-1], 0, True))
            shared = np.full(len(members), 1 << 40, np.int64)
            shared[pair] = left
            depth = np.minimum.reduceat(shared, first)
            depth = np.repeat(depth, np.diff(np.append(first, len(members))))
            a = np.maximum(window - best, low[members])
            z = np.minimum(depth, high[members])
            hit = a <= z
            found.append((members[hit], a[hit], z[hit]))
            # split by the next byte to the left; a string that ends leaves
            go = (self.left[members] > depth) & (window - best <= high[members]) & (depth < high[members])
            members, node, depth = members[go], node[go], depth[go]
            if not len(members):
                break
            child = node * 256 + self.data[self.at[members] - depth - 1]
            by = np.argsort(child, kind="stable")
            members = members[by]
            node = np.unique(child[by], return_inverse=True)[1]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _sorted_suffixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_batches(batches, "kh", least_bytes=2 << 20):
            t = t.combine_chunks()
            col = lambda name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False)
            body = t.column("body").combine_chunks()
            data, offsets = text_buffer(body if not isinstance(body, pa.ChunkedArray) else body.chunk(0))
            base = int(offsets[0]) if len(offsets) else 0
            data, offsets = data[base:int(offsets[-1])], offsets - base
            kh, left, n = col("kh"), col("left").astype(np.int64), col("n").astype(np.int64)
            bounds = np.append(np.flatnonzero(np.insert(kh[1:] != kh[:-1], 0, True)), len(kh))
            at = offsets[:-1] + left
            who, a, z = AnchorSuffixes(data, at, left, offsets[1:] - at).repeated_offsets(
                bounds, window, left - n + 1, left)
            only = col("copies")[who] == 1
            who, a, z = who[only], a[only], z[only]
            if len(who):
                first = col("first")[who] + left[who] - z
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays([
                    t.column("doc_id").combine_chunks().take(rows), t.column("dk").combine_chunks().take(rows),
                    pa.array(first), pa.array(z - a + 1)], names=["doc_id", "dk", "first", "n"])
    return run


_BODY = "doc_id long, dk long, kh long, first long, n int, left int, copies long, body binary, is_hot boolean"


def _bodies(window: int):
    """The bytes of chosen segments, from their document's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: list[list] = [[] for _ in range(9)]
                for doc, dk, is_hot, raw, picks in zip(*(part.column(c).to_pylist() for c in ("doc_id", "dk", "is_hot")),
                                               part.column("text").cast(pa.large_binary()).to_pylist(),
                                               part.column("picks").to_pylist()):
                    for p in picks:
                        row = (doc, dk, p["kh"], p["first"], p["n"], p["left"], p["copies"],
                               raw[p["first"]:p["first"] + p["n"] + window - 1], is_hot)
                        for o, v in zip(out, row):
                            o.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(),
                         pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, types)],
                                                 names=["doc_id", "dk", "kh", "first", "n", "left", "copies", "body", "is_hot"])
    return run


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                data, offsets = text_buffer(part.column("body"))
                base = int(offsets[0])
                data, offsets = data[base:int(offsets[-1])], offsets - base
                n = part.column("n").to_numpy().astype(np.int64)
                starts = ranges(offsets[:-1], n)
                hashes = []
                for which in (0, 1):
                    p = rolling.poly(which)
                    pre = p.prefix(p.table[data])
                    hashes.append(rolling.mix(p.span(pre, starts, starts + window)).view(np.int64))
                rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                first = np.repeat(part.column("first").to_numpy(), n) + starts - np.repeat(offsets[:-1], n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("dk").take(rows), pa.array(first),
                     part.column("copies").take(rows), pa.array(hashes[0]), pa.array(hashes[1])],
                    names=["doc_id", "dk", "first", "copies", "w1", "w2"])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, dk, first, n``: runs of ``n`` byte places at which a repeated
    ``window``-byte string starts."""
    spark = docs.sparkSession
    rows = keyed_text(docs).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = repeated(rows.select("text"), _anchor_hashes(window, gram), int(2 * total / (window - gram + 2)))
    shared = spark.sparkContext.broadcast(sketch)
    seen = scratch_table(rows.mapInArrow(_suspects(window, gram, shared), _SUSPECT))

    place = F.struct("doc_id", "dk", "first", "n", "left")
    kinds = scratch_table(seen.groupBy("kh", "s1", "s2").agg(
        F.count(F.lit(1)).alias("copies"), F.min(place).alias("one")))
    many = kinds.where("copies > 1").select("kh", "s1", "s2")
    whole = (seen.join(many, ["kh", "s1", "s2"])
             .select("doc_id", "dk", "first", F.col("n").cast("long").alias("n")))

    wide = kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least")).where(
        "kinds > 1 AND least = 1").select("kh", (F.col("kinds") > hot).alias("is_hot"))
    picks = (kinds.join(wide, "kh").select("one.*", "kh", "copies", "is_hot")
             .groupBy("doc_id", "dk", "is_hot")
             .agg(F.collect_list(F.struct("kh", "first", "n", "left", "copies")).alias("picks")))
    # rows that repeat as a whole have no segment of their own, so a repeated
    # key only repeats members that are known to be copies
    bodies = scratch_table(picks.join(rows, ["doc_id", "dk"]).mapInArrow(_bodies(window), _BODY))
    cool = (bodies.where("NOT is_hot").repartition("kh").sortWithinPartitions("kh")
            .mapInArrow(_sorted_suffixes(window), "doc_id long, dk long, first long, n long"))
    warm = bodies.where("is_hot")
    each = warm.mapInArrow(_window_hashes(window),
                           "doc_id long, dk long, first long, copies long, w1 long, w2 long")
    twice = each.groupBy("w1", "w2").agg(F.sum("copies").alias("times")).where("times > 1").select("w1", "w2")
    single = (each.where("copies = 1").join(twice, ["w1", "w2"])
              .select("doc_id", "dk", "first", F.lit(1).cast("long").alias("n")))
    return whole.unionAll(cool).unionAll(single)


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for raw, found in zip(part.column("text").cast(pa.large_binary()).to_pylist(),
                                      part.column("spans").to_pylist()):
                    kept, runs = raw or b"", 0
                    if found:
                        spans = np.array([(s["first"], s["first"] + s["n"] + window - 1) for s in found], np.int64)
                        spans = spans[np.argsort(spans[:, 0], kind="stable")]
                        reach = np.maximum.accumulate(spans[:, 1])
                        new = np.insert(spans[1:, 0] > reach[:-1], 0, True)
                        starts = spans[new, 0]
                        ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
                        runs = len(starts)
                        edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(kept)]
                        kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                    out[0].append(len(raw or b""))
                    out[1].append(len(raw or b"") - len(kept))
                    out[2].append(runs)
                    out[3].append(hashlib.sha256(kept).hexdigest())
                    out[4].append(kept if keep_text and runs else None)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(o, k) for o, k in zip(out, types)]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])
    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
                 keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, kept_bytes``; ``kept_bytes`` is null
    where nothing was removed."""
    marked = with_spans(docs, repeated_spans(docs, window, gram, hot), "first", "n")
    return marked.mapInArrow(_cut(window, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                             "kept_sha256 string, kept_bytes binary")
