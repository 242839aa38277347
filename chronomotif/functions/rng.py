"""Portable randomness: numbers in [0, 1) from the MD5 of a key, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(*key) -> Column:
    parts = [F.lit(k) if isinstance(k, (str, int)) and not isinstance(k, Column) else k for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rnd_sql(*key: str) -> str:
    """The DuckDB expression; keys are SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def whole(x: Column, n) -> Column:
    """An integer in [0, n) from a number in [0, 1)."""
    return F.floor(x * n).cast("int")
