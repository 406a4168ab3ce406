"""Language ID by compression: the language whose dictionary packs a text
smallest.

For each language a raw-content zstandard dictionary is made of a bounded
sample of labelled texts: the first ``SAMPLE_BYTES`` of at most
``SAMPLE_DOCS`` documents, those with the smallest id hashes (at most 200 KB a
language, and at most ``MAX_LANGUAGES`` languages, the most frequent ones; so
what goes to the driver and is broadcast is bounded).  Sample texts that the
dictionaries of the other half of the sample assign to another language are
dropped, as labels are noisy and a dictionary would repeat them.

Every whole text is lower-cased, its ASCII non-letters become blanks, and its
pieces of ``PIECE`` bytes are compressed with every dictionary.  ``lang_pred``
has the smallest sum, ties going to the alphabetically first; ``score`` is the
odds that the saved bits give against the second language, 1 / (1 + 2**-bits).
``rejected`` is true where the margin in bytes is below ``min_margin`` plus
``margin_share`` of the smallest sum (noise and mixed texts gain little from
any one dictionary, whatever their length), and where there is nothing to
compress.

Defined results: a text that is null or has no letter, and every text if
nothing was learned, gets ``und``, score 0, rejected; with one language learned
each other text gets it with score 1; a null ``doc_id`` is neither held out nor
learned from; repeated rows are predicted alike; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet.llm.common import text_batches

SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGUAGES = 512, 400, 256
#: Groups of tasks whose rows are ranked apart before a whole language is.
SAMPLE_PARTS = 32
PIECE, LEVEL, MIN_MATCH = 4096, 3, 3
#: Of labelled rows not held out (sf0.1) this rejects 0.7 % of those given their
#: label and 87 % of those given another.
MIN_MARGIN, MARGIN_SHARE = 1, 0.04
UNDETERMINED = "und"

#: ASCII bytes that are no letters become blanks.
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """What is compressed of a text."""
    return b" ".join(text.lower().encode().translate(_BLANK).split())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Classifier:
    """One compressor a language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.names = sorted(samples)
        self.packers = []
        for name in self.names:
            data = b" ".join(samples[name]) or b" "
            setting = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE, dict_size=len(data), min_match=MIN_MATCH, write_content_size=0,
                write_checksum=0, write_dict_id=0)
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=setting)
            self.packers.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=setting).compress)

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[p:p + PIECE] for p in range(0, len(data), PIECE)]
        return [sum(len(pack(p)) for p in pieces) for pack in self.packers]

    def best(self, data: bytes) -> tuple[str, int | None, int]:
        """Language, its margin in bytes (null: nothing to compare with) and its
        size."""
        ranked = sorted(zip(self.sizes(data), self.names))
        return ranked[0][1], ranked[1][0] - ranked[0][0] if len(ranked) > 1 else None, ranked[0][0]


def clean(samples: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """Drop samples that the other half's dictionaries give to another language."""
    halves = [{k: v[h::2] for k, v in samples.items()} for h in (0, 1)]
    out: dict[str, list[bytes]] = {k: [] for k in samples}
    for h in (0, 1):
        other = Classifier({k: v for k, v in halves[1 - h].items() if v})
        for name, texts in halves[h].items():
            out[name] += [t for t in texts if name not in other.names or other.best(t)[0] == name]
    return {k: out[k] or samples[k] for k in samples}


def held_out() -> F.Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Sample texts per language from the labelled documents not held out."""
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull())
    # lang narrow first: ranking must not move texts
    languages = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    order = [F.xxhash64(F.lit(41), "doc_id"), F.col("doc_id")]
    # first in each of SAMPLE_PARTS groups of tasks, so that the last window's
    # input does not grow with the number of tasks; the groups don't matter
    by_part, by = Window.partitionBy("lang", "part").orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    keys = (labelled.select("doc_id", "lang").join(F.broadcast(languages.select("lang")), "lang")
            .withColumn("part", F.spark_partition_id() % SAMPLE_PARTS)
            .withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= sample_docs)
            .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= sample_docs)
            .select("doc_id", "lang", "rank"))
    texts = (labelled.select("doc_id", "lang", F.substring("text", 1, 2 * sample_bytes).alias("text"))
             .join(F.broadcast(keys), ["doc_id", "lang"]).where("text IS NOT NULL").dropDuplicates(["lang", "rank"]))
    samples: dict[str, list[bytes]] = {}
    for r in texts.orderBy("lang", "rank").collect():
        data = letters(r["text"])[:sample_bytes]
        if data and r["lang"] != UNDETERMINED:
            samples.setdefault(r["lang"], []).append(data)
    return clean(samples) if samples else {}


def _predict(shared, min_margin: int, margin_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = shared.value
        model = Classifier(samples) if samples else None
        for b in batches:
            lang, score, rejected = [], [], []
            for text in b.column("text"):
                t = text.as_py()
                data = letters(t) if t else b""
                if model is None or not data or not has_letter(t):
                    lang.append(UNDETERMINED), score.append(0.0), rejected.append(True)
                    continue
                name, margin, size = model.best(data)
                lang.append(name)
                score.append(1.0 if margin is None else 1.0 / (1.0 + 2.0 ** -min(8 * margin, 1000)))
                rejected.append(margin is not None and margin < min_margin + margin_share * size)
            at = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(b.num_columns) if k != at]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[f.name for k, f in enumerate(b.schema) if k != at] + ["lang_pred", "score", "rejected"])
    return run


def language_id(docs: DataFrame, samples: dict[str, list[bytes]] | None = None,
                min_margin: int = MIN_MARGIN, margin_share: float = MARGIN_SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang)``: ``doc_id, held_out,
    lang_pred, score, rejected``."""
    text_batches(docs.sparkSession)
    samples = learn(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    return (docs.select("doc_id", held_out().alias("held_out"), "text")
            .mapInArrow(_predict(shared, min_margin, margin_share),
                        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"))


def keep_identified(docs: DataFrame, samples: dict[str, list[bytes]] | None = None,
                    min_margin: int = MIN_MARGIN, margin_share: float = MARGIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    text_batches(docs.sparkSession)
    samples = learn(docs) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            only = b.select(["text"])
            (marks,) = _predict(shared, min_margin, margin_share)(iter([only]))
            flags = pa.array([not x for x in marks.column("rejected").to_pylist()], pa.bool_())
            yield b.filter(flags)

    return docs.mapInArrow(keep, docs.schema)


def crc32_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
