"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MIN = -2147483648


def log_bucket(x: Column) -> Column:
    """``floor(log2(x + 1))`` as int; 0 for x = 0.  Used for degrees (x >= 0)."""
    return F.floor(F.log2(x.cast("double") + 1.0)).cast("int")


def int_log_bucket(x: Column) -> Column:
    """Attribute bucket: truncate to int, then ``floor(log2(v + 1))``.

    Values with ``v + 1 <= 0`` have no logarithm; they map to the int32 minimum,
    which is what a float NaN/-inf becomes when cast to int32.
    """
    v = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None)).otherwise(
        F.when(F.abs(x.cast("double")) >= 2147483648.0, F.lit(INT32_MIN))
        .otherwise(x.cast("double").cast("int")))
    return F.when(v.isNull() | (v + 1 <= 0), F.lit(INT32_MIN)).otherwise(
        F.floor(F.log2(v.cast("double") + 1.0)).cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 for a timestamp_ntz / timestamp column."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def split_exp_id(exp_id: Column) -> tuple[Column, Column]:
    """``'i;name'`` -> (``'i'``, ``'name'``); ``'name'`` -> (``'0'``, ``'name'``);
    more than one ``;`` raises at run time."""
    parts = F.split(exp_id, ";")
    n = F.size(parts)
    index = (F.when(n == 2, parts.getItem(0)).when(n == 1, F.lit("0"))
             .otherwise(F.raise_error(F.lit("an experiment id is 'name' or 'index;name'"))))
    name = (F.when(n == 2, parts.getItem(1)).when(n == 1, parts.getItem(0))
            .otherwise(F.raise_error(F.lit("an experiment id is 'name' or 'index;name'"))))
    return index, name
