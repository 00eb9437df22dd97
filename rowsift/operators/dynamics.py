"""Training-dynamics metrics and easy / ambiguous / hard assignment.

Input is either a *long* probability table ``(keys..., checkpoint, p)`` or a
*wide* table with ``p ARRAY<DOUBLE>`` (one element per checkpoint). ``p`` is
always the probability of the row's own (gold) label.

Scale notes
-----------
* Long form: one ``groupBy(keys)`` (partial aggregation map-side, so a hot
  key never ships its raw rows to one task).
* Wide form: pure per-row higher-order functions, no shuffle at all.
* ``mi`` and the adaptive threshold need one scalar per group (``source``):
  computed by an aggregate whose output has one row per group and brought
  back by ``attach`` (measured, then broadcast; salted beyond), so rows never
  move by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.operators.attach import attach
from rowsift.session import cut_lineage

EPS = 1e-12
METRIC_COLUMNS = ["confidence", "aleatoric", "variability", "correctness", "entropy"]
# Names accepted for the uncertainty axis of the grouping.
UNCERTAINTY_METRICS = {"aleatoric": "aleatoric", "epistemic": "variability",
                       "entropy": "entropy", "mi": "mi"}


# ------------------------------------------------------------------ K6
def gold_probability(prob: Column, y: Column) -> Column:
    """Probability of the row's own label from a class-probability array (0-based labels)."""
    return F.get(prob, y.cast("int"))


def gold_from_binary(p1: Column, y: Column) -> Column:
    """Binary short-cut: ``y == 0 -> 1 - p``."""
    return F.when(y == 0, 1 - p1).otherwise(p1)


# ------------------------------------------------------------------ K7
def max_probability(long_df: DataFrame, by: Sequence[str] = ("source", "checkpoint"),
                    p: str = "p") -> DataFrame:
    """Max predicted probability per checkpoint over the *whole* table (binary: max(p, 1-p))."""
    return long_df.groupBy(*by).agg(F.max(F.greatest(F.col(p), 1 - F.col(p))).alias("max_probability"))


def max_probability_row(p: Column) -> Column:
    """Per-row variant (not in the reference): max over the row's own history."""
    return F.array_max(F.transform(p, lambda x: F.greatest(x, 1 - x)))


# ------------------------------------------------------------------ K8
def history(long_df: DataFrame, keys: Sequence[str], checkpoint: str = "checkpoint",
            p: str = "p") -> DataFrame:
    """Long -> wide: per row the probabilities ordered by checkpoint."""
    agg = long_df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(checkpoint).alias("c"), F.col(p).alias("p")))).alias("h"))
    return agg.select(*keys, F.transform("h", lambda s: s["p"]).alias("p"))


def explode_history(wide_df: DataFrame, p: str = "p") -> DataFrame:
    """Wide -> long: ``(…, checkpoint, p)`` with 1-based checkpoints."""
    cols = [c for c in wide_df.columns if c != p]
    return wide_df.select(*cols, F.posexplode(p).alias("checkpoint", "_p")).select(
        *cols, (F.col("checkpoint") + 1).cast("int").alias("checkpoint"), F.col("_p").alias(p))


# ------------------------------------------------------------------ K9-K13
def row_dynamics(long_df: DataFrame, keys: Sequence[str], p: str = "p",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Per-row dynamics from the long form (one grouped aggregation)."""
    pc = F.col(p)
    aggs = [F.first(c).alias(c) for c in carry]
    aggs += [
        F.avg(pc).alias("confidence"),
        F.avg(pc * (1 - pc)).alias("aleatoric"),
        F.stddev_pop(pc).alias("variability"),
        F.avg((pc > 0.5).cast("double")).alias("correctness"),
        (-F.sum(pc * F.log(pc + F.lit(EPS)))).alias("entropy"),
        F.count(pc).alias("n_checkpoints"),
    ]
    return long_df.groupBy(*keys).agg(*aggs)


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + f(x))


def wide_dynamics(df: DataFrame, p: str = "p", drop_p: bool = True) -> DataFrame:
    """Per-row dynamics from an ``ARRAY<DOUBLE>`` history; no shuffle."""
    arr = F.col(p)
    n = F.size(arr).cast("double")
    out = df.withColumn("n_checkpoints", F.size(arr).cast("long"))
    out = out.withColumn("confidence", _sum(arr, lambda x: x) / n)
    out = out.withColumn("aleatoric", _sum(arr, lambda x: x * (1 - x)) / n)
    out = out.withColumn("variability",
                         F.sqrt(_sum(arr, lambda x: (x - F.col("confidence")) * (x - F.col("confidence"))) / n))
    out = out.withColumn("correctness", _sum(arr, lambda x: (x > 0.5).cast("double")) / n)
    out = out.withColumn("entropy", -_sum(arr, lambda x: x * F.log(x + F.lit(EPS))))
    return out.drop(p) if drop_p else out


# ------------------------------------------------------------------ K14
def add_mi(dyn: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """``mi = entropy - E`` with ``E = -sum_rows c ln(c + eps)`` per group (table-wide scalar),
    plus ``mi_row`` = entropy - (-c ln c), the per-row textbook variant."""
    c = F.col("confidence")
    term = c * F.log(c + F.lit(EPS))
    e = (dyn.groupBy(*by) if by else dyn).agg((-F.sum(term)).alias("_E"))
    out = attach(dyn, e, list(by))
    return (out.withColumn("mi", F.col("entropy") - F.col("_E"))
               .withColumn("mi_row", F.col("entropy") + term)
               .drop("_E"))


# ------------------------------------------------------------------ K15-K17
def uncertainty_column(metric: str) -> str:
    if metric not in UNCERTAINTY_METRICS:
        raise ValueError(f"unknown curation metric {metric!r}; use one of {sorted(UNCERTAINTY_METRICS)}")
    return UNCERTAINTY_METRICS[metric]


def assign_groups(dyn: DataFrame, metric: str = "aleatoric", ythresh: float = 0.2,
                  xthresh: float = 0.2, by: Sequence[str] = ("source",),
                  conf: str = "confidence") -> DataFrame:
    """Adds ``uncertainty``, ``xthresh`` and ``grp`` in {easy, ambig, hard}.

    hard: conf <= y and u <= x; easy: conf >= 1 - y and u <= x; everything
    else (NaN included) is ambig. ``xthresh == 0`` means adaptive:
    ``0.75 * (max(u) - min(u))`` per group.
    """
    if not 0 <= ythresh < 0.5:
        raise ValueError("ythresh must be in [0, 0.5): easy and hard would overlap")
    ucol = uncertainty_column(metric)
    if ucol == "mi" and "mi" not in dyn.columns:
        dyn = add_mi(dyn, by)
    out = dyn.withColumn("uncertainty", F.col(ucol))
    if xthresh == 0:
        u = F.col("uncertainty")
        thr = (out.groupBy(*by) if by else out).agg((F.lit(0.75) * (F.max(u) - F.min(u))).alias("xthresh"))
        out = attach(out, thr, list(by))
    else:
        out = out.withColumn("xthresh", F.lit(float(xthresh)))
    c, u, x = F.col(conf), F.col("uncertainty"), F.col("xthresh")
    grp = (F.when((c <= ythresh) & (u <= x), "hard")
            .when((c >= 1 - ythresh) & (u <= x), "easy")
            .otherwise("ambig"))
    return out.withColumn("grp", grp)


def dynamics_groups(long_df: DataFrame, keys: Sequence[str] = ("source", "rid"),
                    carry: Sequence[str] = ("y",), metric: str = "aleatoric",
                    ythresh: float = 0.2, xthresh: float = 0.2,
                    by: Sequence[str] = ("source",), with_mi: bool = True) -> DataFrame:
    """Long probability table -> per-row metrics + group (no model needed).

    When a per-group scalar is needed (``mi``, adaptive threshold) the per-row table
    feeds two consumers, so it is written once to the shared checkpoint folder
    instead of repeating the (rows x checkpoints) shuffle."""
    dyn = row_dynamics(long_df, keys, carry=carry)
    if with_mi or xthresh == 0:
        dyn = cut_lineage(dyn, "row-dynamics")
    if with_mi:
        dyn = add_mi(dyn, by)
    return assign_groups(dyn, metric, ythresh, xthresh, by)


# ------------------------------------------------------------------ K19
def group_rank() -> Column:
    return F.when(F.col("grp") == "easy", 1).when(F.col("grp") == "ambig", 2).otherwise(3)


def curated_subset(scored: DataFrame) -> DataFrame:
    """easy + ambig (easy first when ordered), i.e. everything not hard."""
    return scored.where(F.col("grp") != "hard").withColumn("grp_rank", group_rank())


def named_subsets(scored: DataFrame) -> DataFrame:
    """One row per (row, subset) for the five named subsets: easy, ambig, hard, easy_ambig, all."""
    sub = F.array(F.col("grp"), F.when(F.col("grp") != "hard", F.lit("easy_ambig")), F.lit("all"))
    return scored.withColumn("subset", F.explode(F.filter(sub, lambda s: s.isNotNull())))
