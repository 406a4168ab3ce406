"""The six per-list statistics used throughout the feature tables.

For a list of values x the features are ``avg, min, max, sum, std, ent`` with
these conventions (empty list -> 0 everywhere):

* ``std`` is the population standard deviation (divide by n);
* ``ent`` is the Shannon entropy in nats of the *unnormalised* values,
  ``H = -sum(p ln p)`` with ``p = x / S`` and ``S = sum(x)``, 0 when S = 0.
  In one pass: ``H = ln|S| - sum(x ln|x|) / S`` (terms with x = 0 vanish);
  a share p < 0 (a value whose sign differs from S) gives ``-inf``.

Everything is an ordinary aggregate expression, so Spark performs a partial
(map-side) aggregation before the shuffle and a hot group never has to be
collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS = ("avg", "min", "max", "sum", "std", "ent")



def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def entropy_expr(total: Column, sum_xlnx: Column, n_pos: Column, n_neg: Column) -> Column:
    """Entropy from its sufficient statistics (see module docstring)."""
    mixed = ((total > 0) & (n_neg > 0)) | ((total < 0) & (n_pos > 0))
    return (F.when(total.isNull() | (total == 0), F.lit(0.0))
            .when(mixed, F.lit(float("-inf")))
            .otherwise(F.log(F.abs(total)) - sum_xlnx / total))


def xlnx(x: Column) -> Column:
    return F.when(x != 0, x * F.log(F.abs(x))).otherwise(F.lit(0.0))


def six_stat_aggs(x: Column, name: str) -> list[Column]:
    """Aggregate expressions ``{stat}_{name}`` over the non-null values of ``x``."""
    xd = x.cast("double")
    total = F.sum(xd)
    return [
        zero_if_null(F.avg(xd)).alias(f"avg_{name}"),
        zero_if_null(F.min(xd)).alias(f"min_{name}"),
        zero_if_null(F.max(xd)).alias(f"max_{name}"),
        zero_if_null(total).alias(f"sum_{name}"),
        zero_if_null(F.stddev_pop(xd)).alias(f"std_{name}"),
        entropy_expr(total, F.sum(xlnx(xd)),
                     F.count(F.when(xd > 0, 1)), F.count(F.when(xd < 0, 1))).alias(f"ent_{name}"),
    ]


def stats_from_parts(name: str, n: Column, s: Column, mn: Column, mx: Column,
                     var: Column, sxl: Column, n_pos: Column, n_neg: Column) -> list[Column]:
    """The six statistics from already aggregated parts (non-aggregate columns).

    ``var`` is the population variance of the values.  Used where values are
    pre-aggregated (e.g. runs of equal timestamps) before the final reduction.
    """
    has = n > 0
    return [
        F.when(has, s / n).otherwise(0.0).alias(f"avg_{name}"),
        F.when(has, mn).otherwise(0.0).alias(f"min_{name}"),
        F.when(has, mx).otherwise(0.0).alias(f"max_{name}"),
        F.when(has, s).otherwise(0.0).alias(f"sum_{name}"),
        F.when(has, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias(f"std_{name}"),
        F.when(has, entropy_expr(s, sxl, n_pos, n_neg)).otherwise(0.0).alias(f"ent_{name}"),
    ]


def stats_sql(x: str, name: str) -> str:
    """DuckDB/ANSI SQL twin of :func:`six_stat_aggs` (used by the oracle)."""
    return (
        f"coalesce(avg({x}), 0) AS avg_{name}, coalesce(min({x}), 0) AS min_{name}, "
        f"coalesce(max({x}), 0) AS max_{name}, coalesce(sum({x}), 0) AS sum_{name}, "
        f"coalesce(stddev_pop({x}), 0) AS std_{name}, "
        f"CASE WHEN coalesce(sum({x}), 0) = 0 THEN 0 "
        f"WHEN (sum({x}) > 0 AND count(CASE WHEN {x} < 0 THEN 1 END) > 0) "
        f"  OR (sum({x}) < 0 AND count(CASE WHEN {x} > 0 THEN 1 END) > 0) THEN '-inf'::DOUBLE "
        f"ELSE ln(abs(sum({x}))) - sum(CASE WHEN {x} <> 0 THEN {x} * ln(abs({x})) ELSE 0 END) / sum({x}) END "
        f"AS ent_{name}"
    )
