"""Replayable hashing: the single source of randomness in the library.

``h(key, seed) = md5(concat(key, '|', seed))`` orders identically in Spark
and DuckDB, so every sample / split / shuffle can be checked by SQL and
replays exactly on any cluster size (unlike ``rand()`` or ``sampleBy``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h(key, seed) -> Column:
    """32-char lowercase hex md5 of ``key|seed``."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit("|"), F.lit(str(seed))))


def h_sql(key_sql: str, seed) -> str:
    return f"md5(concat({key_sql}, '|', '{seed}'))"


def unit_float(hex_col: Column, offset: int = 0) -> Column:
    """Map 8 hex chars (starting at ``offset``) of a hash to [0, 1)."""
    return F.conv(F.substring(hex_col, offset + 1, 8), 16, 10).cast("double") / float(16 ** 8)


def unit_float_sql(hex_sql: str, offset: int = 0) -> str:
    # DuckDB: parse 8 hex chars as an unsigned integer.
    return f"(CAST(('0x' || substring({hex_sql}, {offset + 1}, 8)) AS UBIGINT)::DOUBLE / {float(16 ** 8)})"


def hex_threshold(frac: float, width: int = 8) -> str:
    """Hex prefix ``t`` such that ``substring(h, 1, width) < t`` keeps ~frac of rows."""
    frac = min(max(float(frac), 0.0), 1.0)
    v = int(frac * 16 ** width)
    if v >= 16 ** width:
        return "g" * width  # above every hex string: keep all
    return format(v, f"0{width}x")
