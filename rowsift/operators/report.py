"""Reports over long result tables (R1-R15): grid, seed means, reshapes,
standard errors, text cells, subgroup sizes, top-k, outlier removal, trends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.operators.attach import attach
from rowsift.session import cut_lineage


# ------------------------------------------------------------------ R1
def grid(results: DataFrame, axes: Sequence[str] = ("dataset", "ns", "seed")) -> DataFrame:
    """Full experiment grid from the distinct axis values (each a small set) with a ``present`` flag."""
    vals = results.agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in axes])  # one row: distinct axis values
    g = vals
    for a in axes:
        g = g.withColumn(a, F.explode(a))
    present = results.select(*axes).distinct().withColumn("present", F.lit(1))
    return g.join(present, list(axes), "left").withColumn("present", F.coalesce("present", F.lit(0)))


# ------------------------------------------------------------------ R2 / R5 / R12
def seed_mean(results: DataFrame, keys: Sequence[str] = ("dataset", "ns", "source", "metric"),
              score: str = "score") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(score).alias("mean"), F.count(score).alias("n_seeds"))


def mean_sem(results: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and standard error (sample std / sqrt(n)) by key (not by row position)."""
    return results.groupBy(*keys).agg(F.avg(score).alias("mean"),
                                      (F.stddev_samp(score) / F.sqrt(F.count(score))).alias("sem"),
                                      F.count(score).alias("n"))


def mean_ci95(results: DataFrame, keys: Sequence[str], score: str = "score",
              contains: Sequence[str] = ()) -> DataFrame:
    """Mean and 1.96 * population std / sqrt(n); optional filter on key text."""
    out = results.groupBy(*keys).agg(F.avg(score).alias("mean"),
                                     (1.96 * F.stddev_pop(score) / F.sqrt(F.count(score))).alias("ci95"))
    if contains:
        cond = None
        for s in contains:
            c = F.col(keys[0]).contains(s)
            cond = c if cond is None else cond | c
        out = out.where(cond)
    return out


# ------------------------------------------------------------------ R3 / R4 / R15
def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "Metric",
                 value: str = "Score") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def long_to_wide(df: DataFrame, row: Sequence[str], pivot: str, values: Sequence, metric: str = "score",
                 fill: float = 0.0) -> DataFrame:
    """One row per ``row`` key, one column per pivot value; missing -> ``fill``."""
    return df.groupBy(*row).pivot(pivot, list(values)).agg(F.first(metric)).na.fill(fill)


# ------------------------------------------------------------------ R6
def fmt_mean_sem(mean: Column, sem: Column, places: int = 2) -> Column:
    """``mean_(sem)`` text cell."""
    return F.concat(F.round(mean, places).cast("string"), F.lit("_("), F.round(sem, places).cast("string"), F.lit(")"))


def fmt_pct(mean: Column, sem: Column, places: int = 2) -> Column:
    """``mean*100 ± sem*100`` rounded."""
    return F.concat(F.round(mean * 100, places).cast("string"), F.lit(" ± "), F.round(sem * 100, places).cast("string"))


# ------------------------------------------------------------------ R7
def subgroup_sizes(df: DataFrame, indicators: Sequence[str], by: Sequence[str] = ("source",)) -> DataFrame:
    """Rows with indicator == 1 per subgroup, long form ``(by..., subgroup, size)``."""
    wide = df.groupBy(*by).agg(*[F.sum((F.col(f"`{c}`") == 1).cast("long")).alias(c) for c in indicators])
    return wide.unpivot(list(by), list(indicators), "subgroup", "size")


# ------------------------------------------------------------------ R8 / R9
def top_k(df: DataFrame, k: int, order: Column, by: Sequence[str] = ("seed",),
          keep: Sequence[str] | None = None, key: str = "subgroup") -> DataFrame:
    """Top k rows per ``by`` (partial top-k before the shuffle), then an optional key filter."""
    w = Window.partitionBy(*by).orderBy(order, F.col(key))
    out = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if keep is not None:
        out = out.where(F.col(key).isin(list(keep)))
    return out


# ------------------------------------------------------------------ R10
def drop_outliers(df: DataFrame, key: Sequence[str], value: str, z: float = 1.0) -> DataFrame:
    """Keep |z| < t within each key group (population std); if nothing survives or std = 0, keep all.

    Group statistics are aggregates attached to the rows (no window holds a group, no row moves by group)."""
    st = df.groupBy(*key).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    zval = F.abs(F.col(value) - F.col("_mu")) / F.col("_sd")
    j = cut_lineage(attach(df, st, list(key)).withColumn("_keep", F.when(F.col("_sd") == 0, F.lit(True)).otherwise(zval < z)), "z-scores")
    any_keep = j.groupBy(*key).agg(F.max(F.col("_keep").cast("int")).alias("_any"))
    return attach(j, any_keep, list(key)).where(F.col("_keep") | (F.col("_any") == 0)).select(*df.columns)


# ------------------------------------------------------------------ R11
def mean_by_size(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x).agg(F.avg(y).alias("mean")).orderBy(x)


def _minor(m: list[list[str]], i: int, j: int) -> list[list[str]]:
    return [[c for k, c in enumerate(row) if k != j] for r, row in enumerate(m) if r != i]


def determinant(m: list[list[str]]) -> str:
    """Determinant of a square matrix of SQL expressions, as an expression (cofactors along the first row)."""
    if len(m) == 1:
        return f"({m[0][0]})"
    terms = [f"{'-' if j % 2 else '+'} ({m[0][j]}) * {determinant(_minor(m, 0, j))}" for j in range(len(m))]
    return f"({' '.join(terms)})"


def trend_sql(degree: int = 3) -> list[str]:
    """Least-squares coefficients (power 0 upwards) over the moments ``s0..`` (sums of powers of x) and ``t0..`` (sums
    of powers of x times y), by Cramer's rule. The same text runs in any SQL engine."""
    n = degree + 1
    left = [[f"s{i + j}" for j in range(n)] for i in range(n)]
    whole = determinant(left)
    return [f"{determinant([[f't{i}' if j == k else left[i][j] for j in range(n)] for i in range(n)])} / {whole}" for k in range(n)]


def polynomial_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = (), degree: int = 3) -> DataFrame:
    """by..., n, c0..c<degree>: the least-squares polynomial of y over z = (x - center) / spread of each group, with
    ``center`` (mean of x) and ``spread`` (largest distance from it, 1 if 0). One aggregate of power sums per group;
    coefficients are null where a group has too few distinct x."""
    by = list(by)
    at = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    st = (at.groupBy(*by) if by else at).agg(F.avg("_x").alias("center"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    spread = F.greatest(F.col("_hi") - F.col("center"), F.col("center") - F.col("_lo"))
    st = st.select(*by, "center", F.when(spread > 0, spread).otherwise(1.0).alias("spread"))
    z = (F.col("_x") - F.col("center")) / F.col("spread")
    power = lambda k: F.lit(1.0) if k == 0 else power(k - 1) * z
    keys = [*by, "center", "spread"]
    sums = attach(at, st, by).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("_x").alias("_distinct"),
                                                *[F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)],
                                                *[F.sum(power(k) * F.col("_y")).alias(f"t{k}") for k in range(degree + 1)])
    fits = F.col("_distinct") > degree
    return sums.select(*keys, "n", *[F.when(fits, F.expr(c)).alias(f"c{k}") for k, c in enumerate(trend_sql(degree))])


def cubic_trend(df: DataFrame, x: str, y: str, degree: int = 3) -> list[float]:
    """Polynomial coefficients over x itself (highest power first, as polyfit); empty with too few distinct x."""
    r = polynomial_trend(df, x, y, degree=degree).first()
    if r is None or r["c0"] is None:
        return []
    out = [0.0] * (degree + 1)
    for k in range(degree + 1):  # c_k * ((x - center) / spread)^k, expanded
        for j in range(k + 1):
            out[j] += r[f"c{k}"] / r["spread"] ** k * math.comb(k, j) * (-r["center"]) ** (k - j)
    return out[::-1]


# ------------------------------------------------------------------ R13
def compare_on_top(a: DataFrame, b: DataFrame, k: int, order: Column, key: str = "subgroup",
                   by: Sequence[str] = ("seed",)) -> DataFrame:
    """Top-k keys of ``a`` (per ``by``), then ``b`` restricted to those keys by a left-semi join."""
    keys = top_k(a, k, order, by, key=key).select(*by, key)
    return b.join(keys, list(by) + [key], "left_semi")


def deep_dive(gains: DataFrame, k: int = 5, z: float = 2.0, key: str = "subgroup", value: str = "gain",
              sizes: Sequence[str] = ("n_orig", "n_gen")) -> DataFrame:
    """R7 + R10 + R6 for one generator: gains over the seeds without outliers as a ``mean+-sem`` cell in percent, and the
    range of the sizes over all seeds, for the k subgroups with the greatest cells (as text, ties by the key)."""
    cells = mean_sem(drop_outliers(gains, [key], value, z), [key], value)
    ranges = gains.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in sizes for n, f in (("min", F.min), ("max", F.max))])
    percent = lambda c: F.round(F.col(c) * 100, 2).cast("string")
    cell = F.concat(percent("mean"), F.lit("+-"), F.coalesce(percent("sem"), F.lit("nan"))).alias("cell")
    return cells.select(key, cell).join(ranges, key).orderBy(F.col("cell").desc(), key).limit(k)


# ------------------------------------------------------------------ R14
def pca_map(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("source", "rid")) -> DataFrame:
    """2-D map of rows from all sources in one space (scaled features -> PCA(2))."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_v")
    sc = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True)
    v = asm.transform(df)
    v = sc.fit(v).transform(v)
    p = PCA(k=2, inputCol="_s", outputCol="_p").fit(v).transform(v)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("_p")
    return p.select(*keep, arr[0].alias("x1"), arr[1].alias("x2"))
