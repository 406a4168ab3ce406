"""Mixing sources to target weights by iterative proportional fitting.

DataFrame functions only.  The documents' token weights are summed per cell
(source, language, topic); the cells are raked: in turn, each marginal's cells
are scaled so that its sums meet the targets, ``rounds`` times.  A document is
then kept with probability ``fitted / tokens`` of its cell, scaled by the
largest such ratio (so none exceeds 1), which makes the expected token shares
of the sample the calibrated ones.  The draw is a hash of ``doc_id`` and seed.

Targets: a marginal's shares are its token shares to the power ``temper``,
scaled to sum to 1 (0: all equal, 1: as they are), or a table of the caller's
with ``value, share``.  A value without a target keeps no weight.

``resample`` needs no largest ratio: its token budget is that of the input, so
a document's expected number of copies is its cell's ``fitted * all tokens /
tokens``, of which the whole part is given and the rest drawn.  A rare cell
gets copies and takes nothing from the others.  It rakes until no marginal is
off its targets by more than ``TOLERANCE`` in all, or until that no longer
falls (targets that no weights meet, as with a source and a language in one
document only), and logs rounds, residual and weights.

Cells and marginals are aggregated map-side, so a source with a third of all
rows is one row a task.  The cell table is broadcast to the documents only if
it has at most ``BROADCAST_CELLS`` rows, else joined by its keys, where AQE
splits a cell with many rows.

Defined results: nulls in source or language are a value of their own; null or
blank text has no tokens and is never kept (probability 0); repeated rows share
a fate; a null ``doc_id`` draws like the word ``null``; an empty table gives no
rows; further columns are ignored or kept as they are.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet.session import scratch_table

logger = logging.getLogger(__name__)

ROUNDS, TEMPER, SEED = 6, 0.7, "mix"
#: Raking of ``resample``: the residual at which it ends, and the fall of it
#: in a round below which it does not get there.
TOLERANCE, LEAST_FALL = 1e-6, 0.01
BROADCAST_CELLS = 20_000
MARGINALS = ("source", "lang", "topic")


def n_tokens(text: str = "text") -> Column:
    """Words: maximal runs without blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r\\x0b\\x0c]+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """Coarse form of a text: what share of it are digits and symbols, and its
    length.  A stand-in for a topic model's column."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(F.translate(t, "0123456789#$%&*+-/:;<=>@[]_{|}~()!", ""))
    marked = 1 - plain / F.greatest(F.length(t), F.lit(1))
    return (F.when(marked > 0.08, "marked").when(F.length(t) < 500, "note")
            .when(F.length(t) < 4000, "article").otherwise("book"))


def draw(seed: str = SEED) -> Column:
    """Uniform in [0, 1) from doc_id and seed (52 bits of an md5)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, by: str, temper: float = TEMPER) -> DataFrame:
    """``value, share``: token shares of a marginal to the power ``temper``."""
    sums = cells.groupBy(F.col(by).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(float(temper))).alias("w")).where("w > 0")
    total = sums.agg(F.sum("w")).first()[0]
    return sums.select("value", (F.col("w") / F.lit(total or 1.0)).alias("share"))


def _round(fitted: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    for by, goal in goals.items():
        sums = fitted.groupBy(by).agg(F.sum("fitted").alias("have")).where("have > 0")
        scale = sums.join(goal, by).select(by, (F.col("share") / F.col("have")).alias("scale"))
        fitted = (fitted.join(scale, by, "left")
                  .withColumn("fitted", F.coalesce(F.col("fitted") * F.col("scale"), F.lit(0.0))).drop("scale"))
    return scratch_table(fitted)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``fitted``, their calibrated
    shares; nulls must have been replaced."""
    total = cells.agg(F.sum("tokens")).first()[0]
    goals = {by: scratch_table(targets[by].select(F.col("value").alias(by), "share")) for by in targets}
    fitted = scratch_table(cells.withColumn("fitted", F.col("tokens") / F.lit(float(total or 1))))
    for _ in range(rounds):
        fitted = _round(fitted, goals)
    return fitted


def probabilities(measured: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS,
                  targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``source, lang, topic, tokens, fitted, probability`` of every cell of
    ``measured(source, lang, topic, tokens)``."""
    cells = scratch_table(measured.where("tokens > 0").groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    targets = targets or {by: tempered(cells, by, temper) for by in MARGINALS}
    fitted = rake(cells, targets, rounds).withColumn("ratio", F.col("fitted") / F.col("tokens"))
    most = fitted.agg(F.max("ratio")).first()[0]
    return fitted.withColumn("probability", F.col("ratio") / F.lit(most or 1.0)).drop("ratio")


def residual(cells: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest, over the marginals, sum of the differences of ``fitted``
    shares from the targets."""
    off = []
    for by, goal in targets.items():
        have = cells.groupBy(F.col(by).alias("value")).agg(F.sum("fitted").alias("have"))
        off.append(have.join(goal, "value", "full").agg(F.sum(F.abs(
            F.coalesce("have", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
    return max(off)


def weights(measured: DataFrame, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None,
            tolerance: float = TOLERANCE) -> DataFrame:
    """``source, lang, topic, tokens, fitted, weight`` of every cell of
    ``measured(source, lang, topic, tokens)``: ``weight`` is a document's
    expected number of copies at the input's number of tokens."""
    fitted = scratch_table(measured.where("tokens > 0").groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    goals = {by: scratch_table(goal) for by, goal in
             (targets or {by: tempered(fitted, by, temper) for by in MARGINALS}).items()}
    fitted = fitted.withColumn("fitted", F.col("tokens") / F.lit(float(total or 1)))
    by_name = {by: goal.withColumnRenamed("value", by) for by, goal in goals.items()}
    off, last, rounds = residual(fitted, goals), float("inf"), 0
    while off > tolerance and off < (1 - LEAST_FALL) * last:
        fitted = _round(fitted, by_name)
        rounds += 1
        last, off = off, residual(fitted, goals)
    out = fitted.withColumn("weight", F.col("fitted") * F.lit(float(total)) / F.col("tokens"))
    least, most, kept = out.agg(F.min("weight"), F.max("weight"), F.sum(
        F.least("weight", F.lit(1.0)) * F.col("tokens"))).first()
    if total:
        logger.log(logging.INFO if off <= tolerance else logging.WARNING,
                   "raked in %d rounds, residual %.3g; weights %.4g to %.4g; %.4f of the tokens are expected to stay",
                   rounds, off, least, most, kept / total)
    return out


def _measured(docs: DataFrame) -> DataFrame:
    null = F.lit("(none)")
    return (docs.withColumn("__source", F.coalesce(F.col("source").cast("string"), null))
            .withColumn("__lang", F.coalesce(F.col("lang").cast("string"), null))
            .withColumn("__topic", topic()).withColumn("__tokens", n_tokens()))


def _measured_rows(docs: DataFrame) -> DataFrame:
    """Measured ``doc_id`` and ``__row``, the whole row: none of its names can
    clash with one of ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return _measured(docs.select("doc_id", "source", "lang", "text", row)).drop("source", "lang", "text")


def _with_probability(measured: DataFrame, cells: DataFrame) -> DataFrame:
    cells = scratch_table(cells.select(*[F.col(c).alias(f"__{c}") for c in MARGINALS], F.col("probability").alias("__p")))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return measured.join(cells, [f"__{c}" for c in MARGINALS], "left").withColumn(
        "__p", F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(F.lit(0.0)))


def _names(measured: DataFrame) -> DataFrame:
    return measured.select(*[F.col(f"__{c}").alias(c) for c in MARGINALS], F.col("__tokens").alias("tokens"))


def mix(docs: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED,
        targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang)``: ``doc_id, topic,
    n_tokens, probability, kept``."""
    measured = scratch_table(_measured(docs.select("doc_id", "source", "lang", "text")).drop("text", "source", "lang"))
    marked = _with_probability(measured, probabilities(_names(measured), temper, rounds, targets))
    return marked.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
                         F.col("__p").alias("probability"), (draw(seed) < F.col("__p")).alias("kept"))


def sample(docs: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED,
           targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    measured = _measured_rows(docs)
    cells = scratch_table(_names(measured).groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    kept = _with_probability(measured, probabilities(cells, temper, rounds, targets)).where(draw(seed) < F.col("__p"))
    return kept.select("__row.*")


def resample(docs: DataFrame, temper: float = TEMPER, seed: str = SEED,
             targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as its cell's
    weight says: the whole part of it, and once more with the rest of it as
    probability."""
    measured = _measured_rows(docs)
    cells = scratch_table(_names(measured).groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")))
    weighted = weights(cells, temper, targets, tolerance).withColumnRenamed("weight", "probability")
    copies = F.floor("__p") + (draw(seed) < F.col("__p") - F.floor("__p")).cast("long")
    return (_with_probability(measured, weighted).withColumn("__n", copies.cast("int")).where("__n > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*"))
