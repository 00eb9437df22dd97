"""Checked queries for the dynamics / curation core."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.operators import dynamics as dyn
from rowsift.operators import sampling, staging
from rowsift.plans.catalog import r6, register
from rowsift.session import cut_lineage
from rowsift.sources import fixtures as fx

F2 = fx.F2_SQL
F1 = fx.F1_SQL

_DYN_SQL = f"""
SELECT source, rid, first(y) AS y,
       avg(p) AS confidence, avg(p * (1 - p)) AS aleatoric, stddev_pop(p) AS variability,
       avg(CAST(p > 0.5 AS DOUBLE)) AS correctness, -sum(p * ln(p + 1e-12)) AS entropy,
       count(p) AS n_checkpoints
FROM ({F2}) f2 GROUP BY source, rid
"""


def _dyn(spark, sf):
    return dyn.row_dynamics(fx.probabilities(spark, sf), ["source", "rid"], carry=["y"])


@register("k6_gold_probability", f"""
SELECT source, rid, checkpoint, round(CASE WHEN y = 0 THEN 1 - p ELSE p END, 6) AS gold
FROM ({F2}) f2""")
def k6_gold_probability(spark, sf):
    # F2's p read as P(class 1): gold = 1 - p for label 0
    df = fx.probabilities(spark, sf)
    return df.select("source", "rid", "checkpoint", r6(dyn.gold_from_binary(F.col("p"), F.col("y")), "gold"))


@register("k7_max_probability", f"""
SELECT source, checkpoint, round(max(greatest(p, 1 - p)), 6) AS max_probability
FROM ({F2}) f2 GROUP BY source, checkpoint""")
def k7_max_probability(spark, sf):
    out = dyn.max_probability(fx.probabilities(spark, sf))
    return out.select("source", "checkpoint", r6("max_probability"))


@register("k8_history", f"""
SELECT source, rid, count(*) AS n,
       round(max(CASE WHEN checkpoint = 1 THEN p END), 6) AS p_first,
       round(max(CASE WHEN checkpoint = 5 THEN p END), 6) AS p_mid,
       round(max(CASE WHEN checkpoint = 9 THEN p END), 6) AS p_last
FROM ({F2}) f2 GROUP BY source, rid""")
def k8_history(spark, sf):
    wide = dyn.history(fx.probabilities(spark, sf), ["source", "rid"])
    return wide.select("source", "rid", F.size("p").cast("long").alias("n"),
                       r6(F.element_at("p", 1), "p_first"), r6(F.element_at("p", 5), "p_mid"),
                       r6(F.element_at("p", -1), "p_last"))


for _m, _k in [("confidence", "k9"), ("aleatoric", "k10"), ("variability", "k11"),
               ("correctness", "k12"), ("entropy", "k13")]:
    def _mk(m):
        def q(spark, sf):
            return _dyn(spark, sf).select("source", "rid", r6(m))
        return q
    register(f"{_k}_{_m}", f"SELECT source, rid, round({_m}, 6) AS {_m} FROM ({_DYN_SQL}) d")(_mk(_m))


@register("k9_k13_wide_dynamics", f"""
SELECT source, rid, round(confidence, 6) AS confidence, round(aleatoric, 6) AS aleatoric,
       round(variability, 6) AS variability, round(correctness, 6) AS correctness,
       round(entropy, 6) AS entropy, n_checkpoints FROM ({_DYN_SQL}) d""")
def k9_k13_wide_dynamics(spark, sf):
    """Same metrics from the array form (no shuffle at all)."""
    w = dyn.wide_dynamics(fx.probabilities_wide(spark, sf))
    return w.select("source", "rid", *[r6(m) for m in dyn.METRIC_COLUMNS], "n_checkpoints")


_MI_SQL = f"""
SELECT d.*, d.entropy - e.big_e AS mi, d.entropy + d.confidence * ln(d.confidence + 1e-12) AS mi_row
FROM ({_DYN_SQL}) d
JOIN (SELECT source, -sum(confidence * ln(confidence + 1e-12)) AS big_e FROM ({_DYN_SQL}) x GROUP BY source) e
  ON d.source = e.source
"""


@register("k14_mi", f"SELECT source, rid, round(mi, 6) AS mi, round(mi_row, 6) AS mi_row FROM ({_MI_SQL}) m")
def k14_mi(spark, sf):
    m = dyn.add_mi(cut_lineage(_dyn(spark, sf), "row-dynamics"), ["source"])
    return m.select("source", "rid", r6("mi"), r6("mi_row"))


@register("k15_metric_epistemic", f"""
SELECT source, rid, round(variability, 6) AS uncertainty,
       CASE WHEN confidence <= 0.2 AND variability <= 0.05 THEN 'hard'
            WHEN confidence >= 0.8 AND variability <= 0.05 THEN 'easy' ELSE 'ambig' END AS grp
FROM ({_DYN_SQL}) d""")
def k15_metric_epistemic(spark, sf):
    g = dyn.assign_groups(_dyn(spark, sf), metric="epistemic", ythresh=0.2, xthresh=0.05)
    return g.select("source", "rid", r6("uncertainty"), "grp")


@register("k16_adaptive_threshold", f"""
SELECT d.source, round(t.xthresh, 6) AS xthresh,
       CAST(sum(CASE WHEN confidence <= 0.2 AND aleatoric <= t.xthresh THEN 1 ELSE 0 END) AS BIGINT) AS n_hard,
       CAST(sum(CASE WHEN NOT (confidence <= 0.2 AND aleatoric <= t.xthresh)
                 AND confidence >= 0.8 AND aleatoric <= t.xthresh THEN 1 ELSE 0 END) AS BIGINT) AS n_easy,
       count(*) AS n_rows
FROM ({_DYN_SQL}) d JOIN (SELECT source, 0.75 * (max(aleatoric) - min(aleatoric)) AS xthresh
                          FROM ({_DYN_SQL}) x GROUP BY source) t ON d.source = t.source
GROUP BY d.source, t.xthresh""")
def k16_adaptive_threshold(spark, sf):
    g = dyn.assign_groups(cut_lineage(_dyn(spark, sf), "row-dynamics"), metric="aleatoric", ythresh=0.2, xthresh=0)
    return g.groupBy("source", "xthresh").agg(
        F.sum((F.col("grp") == "hard").cast("long")).alias("n_hard"),
        F.sum((F.col("grp") == "easy").cast("long")).alias("n_easy"),
        F.count("*").alias("n_rows")).select("source", r6("xthresh"), "n_hard", "n_easy", "n_rows")


_GRP_SQL = f"""
SELECT *, CASE WHEN confidence <= 0.2 AND aleatoric <= 0.2 THEN 'hard'
               WHEN confidence >= 0.8 AND aleatoric <= 0.2 THEN 'easy' ELSE 'ambig' END AS grp
FROM ({_DYN_SQL}) d"""


@register("k17_groups", f"SELECT source, rid, y, grp FROM ({_GRP_SQL}) g")
def k17_groups(spark, sf):
    g = dyn.assign_groups(_dyn(spark, sf), metric="aleatoric", ythresh=0.2, xthresh=0.2)
    return g.select("source", "rid", "y", "grp")


@register("k19_curated_subset", f"""
SELECT source, rid, grp, CASE grp WHEN 'easy' THEN 1 WHEN 'ambig' THEN 2 ELSE 3 END AS grp_rank
FROM ({_GRP_SQL}) g WHERE grp <> 'hard'""")
def k19_curated_subset(spark, sf):
    g = dyn.assign_groups(_dyn(spark, sf))
    return dyn.curated_subset(g).select("source", "rid", "grp", "grp_rank")


@register("k19_named_subsets", f"""
SELECT source, subset, count(*) AS n FROM (
  SELECT source, grp AS subset FROM ({_GRP_SQL}) a
  UNION ALL SELECT source, 'easy_ambig' FROM ({_GRP_SQL}) b WHERE grp <> 'hard'
  UNION ALL SELECT source, 'all' FROM ({_GRP_SQL}) c) s
GROUP BY source, subset""")
def k19_named_subsets(spark, sf):
    g = dyn.assign_groups(_dyn(spark, sf))
    return dyn.named_subsets(g).groupBy("source", "subset").agg(F.count("*").alias("n"))


@register("k21_dynamics_groups", f"""
SELECT source, grp, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_label1,
       round(avg(confidence), 6) AS avg_confidence, round(avg(aleatoric), 6) AS avg_aleatoric
FROM ({_GRP_SQL}) g GROUP BY source, grp""")
def k21_dynamics_groups(spark, sf):
    g = dyn.dynamics_groups(fx.probabilities(spark, sf), with_mi=False)
    return g.groupBy("source", "grp").agg(
        F.count("*").alias("n_rows"), F.sum("y").cast("long").alias("n_label1"),
        r6(F.avg("confidence"), "avg_confidence"), r6(F.avg("aleatoric"), "avg_aleatoric"))


# ---------------------------------------------------------------- model-based (rows-only checks)
def mislabel_report(spark, sf, nest: int = 100, per_class: int = 100, max_depth: int = 6):
    """Flagship: which rows of lineitem are mislabelled?

    F1 -> D1 trusted sample of rows with their own label (per_class per label) -> GBT -> staged
    dynamics of every other row -> easy/ambig/hard -> counts by (grp, flip).
    """
    f1 = fx.labelled(spark, sf)
    trusted, rest = sampling.stratified_split(f1.where("flip = 0"), "y", per_class, "rid", seed=42)
    checked = rest.unionByName(f1.where("flip = 1"))
    scored = staging.curate(trusted, checked, fx.FEATURES, "y", nest=nest, max_depth=max_depth,
                            ythresh=0.2, xthresh=0.2)
    return scored.groupBy("grp", "flip").agg(F.count("*").alias("n_rows"),
                                             r6(F.avg("confidence"), "avg_confidence"))


@register("k18_curate_lineitem")
def k18_curate_lineitem(spark, sf):
    return mislabel_report(spark, sf)


@register("k2_curate_retrain")
def k2_curate_retrain(spark, sf):
    f1 = fx.labelled(spark, sf)
    scored = staging.curate(None, f1, fx.FEATURES, "y", retrain=True)
    return scored.groupBy("grp").agg(F.count("*").alias("n_rows"))


@register("k20_curate_sources")
def k20_curate_sources(spark, sf):
    """Curate every generated source against one trusted table (real rows with their own label), adaptive threshold per source."""
    f4 = fx.real_syn(spark, sf)
    trusted = sampling.stratified_sample(f4.where("source = 'real' AND y = CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT)"), "y", 100, "rid")
    check = f4.where(F.col("source") != "real")
    scored = staging.curate(trusted, check, fx.FEATURES, "y", xthresh=0, metric="aleatoric", by=["source"])
    return scored.groupBy("source", "grp").agg(F.count("*").alias("n_rows"))


@register("k4_forest_staging")
def k4_forest_staging(spark, sf):
    f1 = fx.labelled(spark, sf)
    trusted = sampling.stratified_sample(f1.where("flip = 0"), "y", 200, "rid")
    m = staging.fit_forest(trusted, fx.FEATURES, "y")
    d = cut_lineage(staging.staged_dynamics(m, f1, "y").select("y", *dyn.METRIC_COLUMNS), "forest-dynamics")  # read twice
    return dyn.assign_groups(dyn.add_mi(d, []), by=[]).groupBy("grp").agg(F.count("*").alias("n_rows"))


@register("k5_epoch_refit")
def k5_epoch_refit(spark, sf):
    f1 = fx.labelled(spark, sf)
    trusted = sampling.stratified_sample(f1.where("flip = 0"), "y", 200, "rid")
    long = staging.epoch_refit_history(trusted, f1, fx.FEATURES, "y")
    g = dyn.dynamics_groups(long, keys=["rid"], carry=["y"], by=[], with_mi=False)
    return g.groupBy("grp").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- staged folds by value
# Trees of a fixed shape (two splits each, thresholds spread over the columns' ranges) whose leaf values come from
# the trusted rows by one aggregate, so that SQL can follow every value.
_N_TREES = 24
_RANGES = [("l_quantity", 1.0, 50.0), ("l_extendedprice", 1000.0, 90000.0), ("l_discount", 0.0, 0.1), ("l_tax", 0.0, 0.08)]
_TRUSTED = "substring(md5(concat(rid, '|', 't')), 1, 1) < '4' AND flip = 0"
_LABEL3 = "CASE WHEN l_quantity > 38 THEN 2 ELSE y END"


def _splits(tree: int) -> list[str]:
    """The conditions of a tree's two splits; leaf = 2 * first + second."""
    out = []
    for k in (tree, tree + 1 + tree // 4):
        name, low, high = _RANGES[k % 4]
        out.append(f"{name} > {low + (high - low) * ((5 * k + 3) % 11 + 1) / 13:.6f}")
    return out


_LEAVES = ", ".join(f"2 * CAST({a} AS INTEGER) + CAST({b} AS INTEGER)" for a, b in map(_splits, range(_N_TREES)))


def _leaf_sql(label: str) -> str:
    return f"""
r AS (SELECT row_number() OVER () AS r, rid, {label} AS y, {_TRUSTED} AS trusted, [{_LEAVES}] AS leaf FROM ({F1}) f1),
x AS (SELECT r, rid, y, trusted, unnest(leaf) AS leaf, unnest(range({_N_TREES})) AS tree FROM r)"""


_STAGED_OUT = """
SELECT rid, y, round(avg(g), 6) AS confidence, round(avg(g * (1 - g)), 6) AS aleatoric, round(stddev_pop(g), 6) AS variability,
       round(-sum(g * ln(g + 1e-12)), 6) AS entropy, count(*) AS n_checkpoints FROM p GROUP BY r, rid, y"""


def _leaf_rows(spark, sf, label: str):
    f1 = fx.labelled(spark, sf)
    return f1.select("rid", F.expr(label).alias("y"), F.expr(_TRUSTED).alias("trusted"), F.expr(f"array({_LEAVES})").alias("leaf"))


def _leaf_means(rows, value):
    """(step, tree, leaf, value) from the trusted rows."""
    long = rows.where("trusted").select("y", F.posexplode("leaf").alias("tree", "leaf"))
    return long.groupBy("tree", "leaf").agg(value.alias("value")).select(F.col("tree").alias("step"), "tree", "leaf", "value")


def _staged_out(d):
    return d.select("rid", "y", *[r6(c) for c in ("confidence", "aleatoric", "variability", "entropy")], "n_checkpoints")


def _all_leaves(values, width: int):
    """Leaves that no trusted row reaches add nothing."""
    every = values.sparkSession.range(_N_TREES * 4).select((F.col("id") / 4).cast("int").alias("tree"), (F.col("id") % 4).cast("int").alias("leaf"))
    none = F.array(*[F.lit(0.0)] * width)
    return every.join(values.drop("step"), ["tree", "leaf"], "left").select(F.col("tree").alias("step"), "tree", "leaf", F.coalesce("value", none).alias("value"))


@register("k3_staged_margins", f"""
WITH {_leaf_sql("y")},
v AS (SELECT tree, leaf, 0.3 * avg(2 * y - 1) AS v FROM x WHERE trusted GROUP BY tree, leaf),
f AS (SELECT r, rid, y, x.tree, sum(coalesce(v, 0)) OVER (PARTITION BY r ORDER BY x.tree) AS f
      FROM x LEFT JOIN v ON v.tree = x.tree AND v.leaf = x.leaf),
p AS (SELECT r, rid, y, 1 / (1 + exp(-2 * (2 * y - 1) * f)) AS g FROM f WHERE tree < {_N_TREES - 1})
{_STAGED_OUT}""")
def k3_staged_margins(spark, sf):
    """Margins of boosted trees after every step, for every row."""
    rows = _leaf_rows(spark, sf, "y")
    values = _all_leaves(_leaf_means(rows, F.array(0.3 * F.avg(2 * F.col("y") - 1))), 1)
    return _staged_out(staging.fold_leaves(rows.drop("trusted"), values, "logit", "leaf"))


@register("k4_staged_class_means", f"""
WITH {_leaf_sql(_LABEL3)},
v AS (SELECT tree, leaf, c, avg(CAST(x.y = c AS DOUBLE)) AS v FROM x, (SELECT unnest([0, 1, 2]) AS c) WHERE trusted GROUP BY tree, leaf, c),
f AS (SELECT r, rid, y, x.tree, sum(coalesce(v, 0)) OVER (PARTITION BY r ORDER BY x.tree) / (x.tree + 1) AS g
      FROM x LEFT JOIN v ON v.tree = x.tree AND v.leaf = x.leaf AND v.c = x.y),
p AS (SELECT * FROM f WHERE tree < {_N_TREES - 1})
{_STAGED_OUT}""")
def k4_staged_class_means(spark, sf):
    """Class means of a forest over three classes after every tree, for every row."""
    rows = _leaf_rows(spark, sf, _LABEL3)
    values = _all_leaves(_leaf_means(rows, F.array(*[F.avg((F.col("y") == c).cast("double")) for c in range(3)])), 3)
    return _staged_out(staging.fold_leaves(rows.drop("trusted"), values, "mean", "leaf"))
