"""Per-key values (a threshold, a range, a total) brought to the rows of a large table.

A plain join would shuffle the large side by the key, so that a key with a third of the rows lands in
one task. ``attach`` materialises the small side, measures it, and broadcasts it only if it is proven
small; beyond that the small side is repeated per salt and the large side is dealt over the salts, so
that a hot key is spread as well. The large side never moves by the key alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.session import cut_lineage

BROADCAST_BYTES = 16 << 20
SALTS = 32


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of a materialised table: 8 per fixed-size cell, the length of the others as text, 16 a row."""
    fixed = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp"}
    wide = [c for c, t in df.dtypes if t not in fixed]
    size = F.lit(16 + 8 * (len(df.columns) - len(wide)))
    for c in wide:
        text = F.col(c) if dict(df.dtypes)[c] == "string" else F.to_json(F.struct(c))
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"])


def attach(df: DataFrame, scalars: DataFrame, keys: Sequence[str], limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``df`` and the other columns of ``scalars`` (one row per ``keys``; null where a key has none). Null keys meet null keys."""
    small = cut_lineage(scalars, "scalars")
    if not keys:
        if small.count() != 1:
            raise ValueError("without keys there must be one row of values")
        return df.crossJoin(F.broadcast(small))  # one row
    small = small.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = None
    for k in keys:
        one = df[k].eqNullSafe(small[f"_key_{k}"])
        same = one if same is None else same & one
    drop = [f"_key_{k}" for k in keys]
    if measured_bytes(small) <= limit:
        return df.join(F.broadcast(small), same, "left").drop(*drop)
    dealt = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_key_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = dealt["_salt"] == repeated["_key_salt"]
    for k in keys:
        same = same & dealt[k].eqNullSafe(repeated[f"_key_{k}"])
    return dealt.join(repeated, same, "left").drop("_salt", "_key_salt", *drop)
