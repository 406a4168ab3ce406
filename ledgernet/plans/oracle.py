"""Helpers shared by the query registry and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so that results compare across engines
    (``+ 0.0`` turns a negative zero into zero)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded_sql(inner: str, double_cols: list[str], digits: int = DIGITS) -> str:
    if not double_cols:
        return inner
    rep = ", ".join(f'(round("{c}", {digits}) + 0.0) AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS q"
