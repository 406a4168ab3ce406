"""Deterministic uniform draws.

``u(seed, k1, k2, ...)`` hashes the keys with MD5 and reads the first 13 hex
digits (52 bits) as a fraction in [0, 1).  The value depends only on the keys,
never on partitioning, task retries or executor loss, unlike ``rand()``, so
every sampled operator is reproducible and re-runnable after a failure.  The
same expression is available in DuckDB, which lets sampled operators be
checked row for row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2 ** 52)


def uniform(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [
        (k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys
    ]
    hexs = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(hexs, 16, 10).cast("long").cast("double") / F.lit(_SCALE)


def uniform_sql(seed, *keys: str) -> str:
    """DuckDB twin of :func:`uniform`; ``keys`` are SQL expressions."""
    inner = ", ".join([f"'{seed}'"] + [f"cast({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 13))::BIGINT / {_SCALE!r})"
