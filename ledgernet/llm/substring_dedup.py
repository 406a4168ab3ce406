"""Substring dedup with a count-min prefilter (50-word windows).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes when a window that
covers it starts with the same words in a document with a smaller ``doc_id``.

1. Every partition sketches the anchors of all its windows (see ``rolling``);
   the merged sketch overestimates each window's count, so windows it calls
   single can be left alone and none that repeats is lost.
2. A second pass over the texts keeps the segments whose anchors may repeat.
   Equal segments are counted as one row (map-side first), so a passage in a
   third of all documents costs one row a task.
3. Segments that share an anchor but not their whole content are compared
   window by window, by 96 hash bits, again aggregated before the shuffle.  A
   third pass over the texts makes these hashes, of one document a segment.

Defined results: null text has no words; a null ``doc_id`` is neither smaller
nor larger than another, such a row is returned unchanged; rows with the same
``doc_id`` don't remove each other's words; texts of under 50 words stay; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm import rolling
from ledgernet.llm.common import NO_ID, keyed_text, list_array, ranges, steps, text_buffer, with_spans
from ledgernet.llm.sketch import members, repeated
from ledgernet.session import scratch_table

#: Words of a window; words of an anchor string inside it.
WINDOW, GRAM = 50, 20


def _segments(column: pa.Array, window: int, gram: int):
    """``(first row, bounds of the rows' words, Segments, first word)``."""
    buf, offsets = text_buffer(column)
    for i, j in steps(offsets):
        start, end, bounds = rolling.word_spans(buf, offsets[i:j + 1])
        h = rolling.word_hashes(buf, start, end)
        for seg, lo, row in rolling.segment_runs(lambda a, z: h[a:z], bounds, window, gram):
            yield i + row, bounds[row:], seg, lo


def _anchor_hashes(window: int, gram: int):
    def run(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, seg, _ in _segments(b.column("text"), window, gram):
            yield seg.key
    return run


def _suspects(window: int, gram: int, sketch):
    """Segments whose anchors may repeat: their place, number of windows and
    content; no windows, which are a multiple of that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = sketch.value
        for b in batches:
            ids, dks = b.column("doc_id"), b.column("dk")
            for row, bounds, seg, lo in _segments(b.column("text"), window, gram):
                only = np.flatnonzero(maybe(seg.key))
                if not len(only):
                    continue
                s1, s2 = seg.content(only)
                at = pa.array(seg.seq[only] + row)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), dks.take(at),
                    pa.array(seg.first[only] + lo - bounds[seg.seq[only]]), pa.array(seg.count[only]),
                    pa.array(seg.key[only].view(np.int64)),
                    pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                ], names=["doc_id", "dk", "first", "n", "kh", "s1", "s2"])
    return run


def _windows(window: int, gram: int, sketch, chosen):
    """The windows of the segments that ``chosen`` may hold (by ``s1 ^ doc_id``)
    among those of ``_suspects``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, wanted = sketch.value, chosen.value
        for b in batches:
            ids, dks = b.column("doc_id"), b.column("dk")
            doc = ids.to_numpy().view(np.uint64)
            for row, bounds, seg, lo in _segments(b.column("text"), window, gram):
                only = np.flatnonzero(maybe(seg.key))
                if not len(only):
                    continue
                only = only[wanted(seg.content(only)[0] ^ doc[seg.seq[only] + row])]
                if not len(only):
                    continue
                w1, w2 = seg.windows(ranges(seg.first[only], seg.count[only]))
                at = pa.array(seg.seq[only] + row)
                yield pa.RecordBatch.from_arrays([
                    ids.take(at), dks.take(at),
                    pa.array(seg.first[only] + lo - bounds[seg.seq[only]]),
                    list_array(pa.array(w1.view(np.int64)), seg.count[only]),
                    list_array(pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), seg.count[only]),
                ], names=["doc_id", "dk", "first", "w1", "w2"])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, dk, first, n``: runs of ``n`` window starts whose windows also
    start in a document with a smaller id (``dk``: see ``common.text_key``)."""
    spark = docs.sparkSession
    rows = keyed_text(docs).where((F.col("doc_id") != NO_ID) & F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # words of about six bytes, one anchor in (window - gram) / 2 words
    sketch = repeated(rows.select("text"), _anchor_hashes(window, gram),
                      int(total / (3 * (window - gram + 2))))
    shared = spark.sparkContext.broadcast(sketch)
    seen = scratch_table(rows.mapInArrow(_suspects(window, gram, shared), "doc_id long, dk long, first long, n long, "
                                         "kh long, s1 long, s2 long"))

    kinds = seen.groupBy("kh", "s1", "s2").agg(F.min("doc_id").alias("least"))
    several = kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("kh")
    kinds = kinds.join(several.withColumn("several", F.lit(True)), "kh", "left")
    placed = scratch_table(
        seen.join(kinds, ["kh", "s1", "s2"])
        .withColumn("later", F.col("doc_id") > F.col("least"))
        .where("later OR several")
        .select("doc_id", "dk", "first", "later", "n", F.when(~F.col("later"), F.col("s1").bitwiseXOR(F.col("doc_id"))).alias("own")))
    whole = placed.where("later").select("doc_id", "dk", "first", "n")

    # hashes of the windows are made where they are compared; those of segments
    # that ``chosen`` passes by chance are windows of the texts like others
    first = placed.where("NOT later")
    chosen = spark.sparkContext.broadcast(members(first, "own", first.count()))
    each = (scratch_table(rows.mapInArrow(_windows(window, gram, shared, chosen),
                                          "doc_id long, dk long, first long, w1 array<long>, w2 array<int>"))
            .select("doc_id", "dk", "first", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
            .select("doc_id", "dk", (F.col("first") + F.col("i")).alias("first"), "w.w1", "w.w2"))
    earliest = each.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    single = (each.join(earliest, ["w1", "w2"]).where("least < doc_id")
              .select("doc_id", "dk", "first", F.lit(1).cast("long").alias("n")))
    return whole.unionAll(single)


def _strip(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for raw, found in zip(part.column("text").cast(pa.large_binary()).to_pylist(),
                                      spans.slice(at, 256).to_pylist()):
                    words = (raw or b"").split()
                    gone = 0
                    kept = words
                    if found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s in found:
                            edge[s["first"]] += 1
                            edge[min(s["first"] + s["n"] + window - 1, len(words))] -= 1
                        stay = np.cumsum(edge[:-1]) == 0
                        gone = len(words) - int(stay.sum())
                        kept = list(compress(words, stay.tolist()))
                    joined = b" ".join(kept)
                    out[0].append(len(words))
                    out[1].append(gone)
                    out[2].append(hashlib.sha256(joined).hexdigest())
                    out[3].append(joined.decode() if keep_text and gone else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("dk"), pa.array(out[0], pa.int64()),
                     pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                    names=["doc_id", "dk", "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words,
    n_removed, kept_sha256, kept_text``; ``kept_text`` (kept words joined by
    one space) is null where nothing was removed."""
    marked = with_spans(docs, repeated_spans(docs, window, gram), "first", "n")
    return marked.mapInArrow(_strip(window, keep_text), "doc_id long, dk long, n_words long, n_removed long, "
                             "kept_sha256 string, kept_text string")
