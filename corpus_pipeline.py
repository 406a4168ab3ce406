"""A training-data pipeline over ``documents``: language ID, near-duplicate
removal, substring dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.llm import language_id as lid
from ledgernet.llm import mixing, ngram_join, packing, substring_dedup
from ledgernet.llm.common import NO_ID, table, text_key
from ledgernet.llm.registry import WORD_END, WORD_VOCABULARY, vocabulary
from ledgernet.session import ensure_checkpoint_dir, scratch_table

#: Tempering of the marginals in the mixing stage.
TEMPER = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letters, or a narrow margin) go."""
    return lid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id.  Rows
    that share an id are one document; the smallest row text stays."""
    gone = scratch_table(ngram_join.ngram_join(docs).where("NOT kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")))
    may, stay = ngram_join.by_membership(docs.where("doc_id IS NOT NULL"), ["doc_id"], gone)  # only these are shuffled
    out = stay.unionByName(may.join(gone, "doc_id", "left_anti").select(*docs.columns))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        columns = docs.columns
        out = out.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c not in ("doc_id", "text")]))
                                        .alias("__row")).select("doc_id", "__row.*").select(*columns)
    return out.unionByName(docs.where("doc_id IS NULL"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier document's passage go from the texts (the
    kept words are joined by one blank, ``n_chars`` follows); documents of which
    nothing is left go."""
    found = substring_dedup.substring_dedup(docs).where("n_removed > 0").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("dk").alias("__dk"),
        F.col("kept_text").alias("__kept")).dropDuplicates(["__id", "__dk"])
    # the whole row in one column: names of its own can't clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    out = (docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), text_key().alias("__dk"), row)
           .join(found, ["__id", "__dk"], "left").where("__kept IS NULL OR __kept <> ''"))
    new = {"text": F.coalesce("__kept", "__row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__kept").isNotNull(), F.length("__kept").cast("long")).otherwise(F.col("__row.n_chars"))
    return out.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, in expectation, in the raked shares: documents
    of common cells are thinned a little, those of rare cells repeated."""
    return mixing.resample(docs, temper=TEMPER)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row per packed piece."""
    return packing.pack_documents(docs, vocabulary(WORD_VOCABULARY), WORD_END)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the compressor nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
