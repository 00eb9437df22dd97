"""Column projections and encodings (P1-P20) as built-in column expressions.

Each helper returns a ``Column`` or a ``DataFrame`` transform; nothing leaves
the JVM. Column names may contain spaces, dots and dashes: always quoted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def q(name: str) -> Column:
    """Quoted column reference (names like ``grade_1.0`` or ``capital-gain``)."""
    return F.col("`" + name.replace("`", "``") + "`")


# ------------------------------------------------------------------ P1-P4
def split_features_label(df: DataFrame, label: str, features: Sequence[str] | None = None,
                         keys: Sequence[str] = ()) -> DataFrame:
    """One frame carrying keys, features and the label (never two aligned frames)."""
    feats = list(features) if features is not None else [c for c in df.columns if c != label and c not in keys]
    return df.select(*[q(k) for k in keys], *[q(c) for c in feats], q(label))


def select_positions(df: DataFrame, positions: Sequence[int], drop: Sequence[str] = ()) -> DataFrame:
    cols = [df.columns[i] for i in positions]
    return df.select(*[q(c) for c in cols]).drop(*drop)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


# ------------------------------------------------------------------ P5
def onehot_to_ordinal(cols: Sequence[str], values: Sequence[int] | None = None) -> Column:
    """First one-hot column equal to 1 wins; none -> NULL."""
    values = list(values) if values is not None else list(range(1, len(cols) + 1))
    return F.coalesce(*[F.when(q(c) == 1, F.lit(v)) for c, v in zip(cols, values)])


# ------------------------------------------------------------------ P6 / P14
def map_values(c: Column, mapping: Mapping, strict: bool = False) -> Column:
    """Dictionary map; unmatched -> NULL, or an error when ``strict``."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    out = F.try_element_at(m, c)
    if strict:
        out = F.when(out.isNull(), F.raise_error(F.concat(F.lit("unmapped value: "), c.cast("string")))).otherwise(out)
    return out


def lookup(c: Column, mapping: Mapping) -> Column:
    """``encoder[s]`` - raises on a missing key (ANSI ``element_at``)."""
    return map_values(c, mapping, strict=True)


# ------------------------------------------------------------------ P7 / P8 / P10
def replace_values(c: Column, olds: Sequence, new) -> Column:
    """Unmatched values are kept."""
    return F.when(c.isin(list(olds)), F.lit(new)).otherwise(c)


def two_way(c: Column, equals, yes="US", no="Non-US") -> Column:
    return F.when(c == F.lit(equals), F.lit(yes)).otherwise(F.lit(no))


def sign_indicator(c: Column) -> Column:
    """>0 -> 1, ==0 -> 0, negatives (and NULL) untouched."""
    return F.when(c > 0, F.lit(1)).when(c == 0, F.lit(0)).otherwise(c)


# ------------------------------------------------------------------ P9
def merge_categories(c: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Many-to-few merge, first matching group wins, everything else -> default."""
    out = None
    for name, members in groups:
        cond = c.isin(list(members))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


# ------------------------------------------------------------------ P11
def ordinal_encode(c: Column, ordering: Sequence[str], on_unseen: str = "raise") -> Column:
    """0-based position in ``ordering``; unseen -> error (``raise``) or NULL (``null``)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in ordering]), c) - 1
    if on_unseen == "raise":
        return F.when(c.isNull() | (pos >= 0), F.when(pos >= 0, pos)).otherwise(
            F.raise_error(F.concat(F.lit("value not in ordering: "), c.cast("string"))))
    return F.when(pos >= 0, pos)


# ------------------------------------------------------------------ P12
def nominal_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Codes by sorted distinct value (0-based), NULL -> -1.

    Exact dense rank without a single-partition window: distinct values are
    range-partitioned by value, numbered inside each (bounded) partition,
    materialised once (range bounds come from sampling, so both uses must see
    the same partitioning), then shifted by per-partition offsets (one row per
    partition collected) and joined back on the value.
    """
    from rowsift.session import cut_lineage
    out = out or col
    distinct = df.select(q(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    ranged = distinct.repartitionByRange("_v").withColumn("_pid", F.spark_partition_id())
    numbered = cut_lineage(ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy("_v"))),
                           "nominal-codes")
    counts = sorted((r["_pid"], r["n"]) for r in numbered.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    acc, offs = 0, []
    for pid, n in counts:  # one row per range partition
        offs.append((pid, acc))
        acc += n
    offsets = df.sparkSession.createDataFrame(offs, "_pid int, _off long")
    codes = numbered.join(F.broadcast(offsets), "_pid").select("_v", (F.col("_off") + F.col("_rn") - 1).alias("_code"))
    joined = df.join(codes, q(col) == F.col("_v"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_v", "_code")


# ------------------------------------------------------------------ P13
def binary_equals(c: Column, value) -> Column:
    return (c == F.lit(value)).cast("int")


def binary_not_in(c: Column, values: Sequence) -> Column:
    return (~c.isin(list(values))).cast("int")


# ------------------------------------------------------------------ P15 / P16 / P17
def anonymise(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """Rename to feat_0..feat_{n-2}, target (label last); returns the original names."""
    original = [c for c in df.columns if c != label] + [label]
    names = [f"feat_{i}" for i in range(len(original) - 1)] + ["target"]
    return df.select(*[q(c) for c in original]).toDF(*names), original


def restore_names(df: DataFrame, original: Sequence[str]) -> DataFrame:
    return df.toDF(*original)


def select_like(df: DataFrame, example_columns: Sequence[str]) -> DataFrame:
    """Columns of the example, in its order; extras dropped, missing -> NULL."""
    have = set(df.columns)
    return df.select(*[q(c) if c in have else F.lit(None).alias(c) for c in example_columns])


def fill_from(target: Column, other: Column) -> Column:
    return F.coalesce(target, other)


# ------------------------------------------------------------------ P18
def repair_label(raw: Column) -> Column:
    """1 < v < 50000 -> 0, v >= 50000 -> 1, else v; non-numeric and NaN -> NULL (drop after)."""
    v = raw.cast("string").try_cast("double")
    v = F.when(~F.isnan(v), v)  # NaN counts as larger than any number here
    return F.when((v > 1) & (v < 50000), F.lit(0.0)).when(v >= 50000, F.lit(1.0)).otherwise(v)


# ------------------------------------------------------------------ P19 / P20
def moments(ref: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of each column, for ``standardise``."""
    return ref.agg(*[F.avg(q(c)).alias(f"_mu_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(q(c)).alias(f"_sd_{i}") for i, c in enumerate(cols)])


def standardise(df: DataFrame, cols: Sequence[str], ref: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std_pop, std 0 -> divide by 1. Stats from ``ref`` (default: df), or ``moments`` given as ``stats``.

    One aggregate (one row: size proven) crossed in by broadcast.
    """
    stats = moments(ref if ref is not None else df, cols) if stats is None else stats
    out = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(cols):
        sd = F.col(f"_sd_{i}")
        out = out.withColumn(c, (q(c) - F.col(f"_mu_{i}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return out.drop(*[f"_mu_{i}" for i in range(len(cols))], *[f"_sd_{i}" for i in range(len(cols))])


def minmax_scale(df: DataFrame, cols: Sequence[str], ref: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min) with stats from ``ref``; constant column -> 0."""
    ref = ref if ref is not None else df
    stats = ref.agg(*[F.min(q(c)).alias(f"_lo_{i}") for i, c in enumerate(cols)],
                    *[F.max(q(c)).alias(f"_hi_{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(cols):
        lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        out = out.withColumn(c, F.when(hi == lo, F.lit(0.0)).otherwise((q(c) - lo) / (hi - lo)))
    return out.drop(*[f"_lo_{i}" for i in range(len(cols))], *[f"_hi_{i}" for i in range(len(cols))])
