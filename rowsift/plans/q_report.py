"""Checked queries for reports (R1-R15) over the results fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.operators import report as rp
from rowsift.plans.catalog import r6, register
from rowsift.session import table
from rowsift.sources import fixtures as fx

F8 = fx.F8_SQL
F9 = fx.F9_SQL
# Model columns of the wide comparison tables.
MODELS = ["Original", "gpt4", "gpt4_curated", "tvae"]
ABLATION = ["gpt4", "gpt4_curated"]
CELLS = ["dataset", "seed", "metric", "ns"]


@register("r1_grid", f"""
WITH r AS ({F8}),
g AS (SELECT d.dataset, n.ns, s.seed FROM (SELECT DISTINCT dataset FROM r) d, (SELECT DISTINCT ns FROM r) n,
                                          (SELECT DISTINCT seed FROM r) s),
p AS (SELECT DISTINCT dataset, ns, seed FROM r)
SELECT g.dataset, g.ns, g.seed, CASE WHEN p.dataset IS NULL THEN 0 ELSE 1 END AS present
FROM g LEFT JOIN p ON g.dataset = p.dataset AND g.ns = p.ns AND g.seed = p.seed""")
def r1_grid(spark, sf):
    return rp.grid(fx.results(spark, sf)).select("dataset", "ns", "seed", F.col("present").cast("int"))


@register("r2_seed_mean", f"""
SELECT dataset, ns, source, metric, round(avg(score), 6) AS mean, count(score) AS n_seeds
FROM ({F8}) r GROUP BY dataset, ns, source, metric""")
def r2_seed_mean(spark, sf):
    return rp.seed_mean(fx.results(spark, sf)).select("dataset", "ns", "source", "metric", r6("mean"), "n_seeds")


_WIDE = f"""SELECT dataset, ns, seed, source, max(CASE WHEN metric = 'accuracy' THEN score END) AS Accuracy,
       max(CASE WHEN metric = 'auc' THEN score END) AS AUC FROM ({F8}) r GROUP BY dataset, ns, seed, source"""


def _wide(spark, sf):
    r = fx.results(spark, sf)
    return r.groupBy("dataset", "ns", "seed", "source").pivot("metric", ["accuracy", "auc"]).agg(
        F.first("score")).withColumnRenamed("accuracy", "Accuracy").withColumnRenamed("auc", "AUC")


@register("r3_wide_to_long", f"""
SELECT dataset, ns, seed, source, Metric, round(Score, 6) AS Score FROM (
  UNPIVOT ({_WIDE}) ON Accuracy, AUC INTO NAME Metric VALUE Score) u""")
def r3_wide_to_long(spark, sf):
    long = rp.wide_to_long(_wide(spark, sf), ["dataset", "ns", "seed", "source"], ["Accuracy", "AUC"])
    return long.where(F.col("Score").isNotNull()).select("dataset", "ns", "seed", "source", "Metric", r6("Score"))


@register("r4_long_to_wide", f"""
SELECT dataset, seed, metric, ns, {', '.join(f"round(coalesce(max(CASE WHEN source = '{m}' THEN score END), 0), 6) AS {m}" for m in MODELS)}
FROM ({F8}) r GROUP BY dataset, seed, metric, ns""")
def r4_long_to_wide(spark, sf):
    w = rp.long_to_wide(fx.results(spark, sf), CELLS, "source", MODELS, "score")
    return w.select(*CELLS, *[r6(m) for m in MODELS])


@register("r5_mean_sem", f"""
SELECT dataset, ns, source, metric, round(avg(score), 6) AS mean,
       round(stddev_samp(score) / sqrt(count(score)), 6) AS sem, count(score) AS n
FROM ({F8}) r GROUP BY dataset, ns, source, metric""")
def r5_mean_sem(spark, sf):
    m = rp.mean_sem(fx.results(spark, sf), ["dataset", "ns", "source", "metric"])
    return m.select("dataset", "ns", "source", "metric", r6("mean"), r6("sem"), "n")


@register("r6_text_cells", f"""
SELECT dataset, ns, source, metric,
       concat(CAST(round(m, 2) AS VARCHAR), '_(', CAST(round(s, 2) AS VARCHAR), ')') AS cell,
       concat(CAST(round(m * 100, 2) AS VARCHAR), ' ± ', CAST(round(s * 100, 2) AS VARCHAR)) AS pct
FROM (SELECT dataset, ns, source, metric, avg(score) AS m, stddev_samp(score) / sqrt(count(score)) AS s
      FROM ({F8}) r GROUP BY dataset, ns, source, metric) x""")
def r6_text_cells(spark, sf):
    m = rp.mean_sem(fx.results(spark, sf), ["dataset", "ns", "source", "metric"])
    return m.select("dataset", "ns", "source", "metric", rp.fmt_mean_sem(F.col("mean"), F.col("sem")).alias("cell"),
                    rp.fmt_pct(F.col("mean"), F.col("sem")).alias("pct"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("r7_subgroup_sizes", f"""
SELECT source, subgroup, size FROM (UNPIVOT (
  SELECT CASE WHEN c_acctbal > 0 THEN 'orig' ELSE 'gen' END AS source,
         {', '.join(f"CAST(sum(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS seg_{s.lower()}" for s in _SEG)}
  FROM customer GROUP BY 1) ON {', '.join(f'seg_{s.lower()}' for s in _SEG)} INTO NAME subgroup VALUE size) u""")
def r7_subgroup_sizes(spark, sf):
    c = table(spark, sf, "customer")
    onehot = c.select(F.when(F.col("c_acctbal") > 0, "orig").otherwise("gen").alias("source"),
                      *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg_{s.lower()}") for s in _SEG])
    return rp.subgroup_sizes(onehot, [f"seg_{s.lower()}" for s in _SEG])


@register("r8_top_k_subgroups", f"""
SELECT seed, subgroup, rank FROM (SELECT seed, subgroup,
  row_number() OVER (PARTITION BY seed ORDER BY gain DESC, subgroup) AS rank FROM ({F9}) g) x
WHERE rank <= 5 AND subgroup NOT LIKE 'error%'""")
def r8_top_k_subgroups(spark, sf):
    g = fx.subgroup_gains(spark, sf)
    top = rp.top_k(g, 5, F.col("gain").desc()).where(~F.col("subgroup").startswith("error"))
    return top.select("seed", "subgroup", F.col("rank").cast("long"))


@register("r9_top_k_text_order", f"""
SELECT seed, subgroup, txt FROM (SELECT seed, subgroup, concat(CAST(round(gain * 100, 2) AS VARCHAR), ' ± 0.0') AS txt,
  row_number() OVER (PARTITION BY seed ORDER BY concat(CAST(round(gain * 100, 2) AS VARCHAR), ' ± 0.0') DESC, subgroup) AS rk
  FROM ({F9}) g) x WHERE rk <= 5""")
def r9_top_k_text_order(spark, sf):
    g = fx.subgroup_gains(spark, sf).withColumn("txt", rp.fmt_pct(F.col("gain"), F.lit(0.0)))
    return rp.top_k(g, 5, F.col("txt").desc()).select("seed", "subgroup", "txt")


@register("r10_drop_outliers", f"""
WITH g AS ({F9}),
s AS (SELECT subgroup, avg(gain) AS mu, stddev_pop(gain) AS sd FROM g GROUP BY subgroup),
j AS (SELECT g.*, CASE WHEN sd = 0 THEN true ELSE abs(gain - mu) / sd < 1 END AS keep FROM g JOIN s USING (subgroup)),
a AS (SELECT subgroup, max(CAST(keep AS INTEGER)) AS any_keep FROM j GROUP BY subgroup)
SELECT seed, subgroup, round(gain, 6) AS gain FROM j JOIN a USING (subgroup) WHERE keep OR any_keep = 0""")
def r10_drop_outliers(spark, sf):
    out = rp.drop_outliers(fx.subgroup_gains(spark, sf), ["subgroup"], "gain", 1.0)
    return out.select("seed", "subgroup", r6("gain"))


@register("r11_mean_gain_by_size", f"""
SELECT n_orig, round(avg(gain), 6) AS mean FROM ({F9}) g GROUP BY n_orig""")
def r11_mean_gain_by_size(spark, sf):
    return rp.mean_by_size(fx.subgroup_gains(spark, sf), "n_orig", "gain").select("n_orig", r6("mean"))


_MOMENTS = ", ".join([f"sum(power(z, {k})) AS s{k}" for k in range(7)] + [f"sum(power(z, {k}) * gain) AS t{k}" for k in range(4)])


def _trend_oracle(by: str) -> str:
    """Least squares from moments of z = (x - center) / spread; too few distinct sizes: null."""
    return f"""
WITH g AS ({F9}),
c AS (SELECT {by} AS k, avg(n_orig) AS center, greatest(max(n_orig) - avg(n_orig), avg(n_orig) - min(n_orig)) AS spread FROM g GROUP BY {by}),
x AS (SELECT {by} AS k, center, CASE WHEN spread > 0 THEN spread ELSE 1 END AS spread, gain, n_orig,
             (n_orig - center) / CASE WHEN spread > 0 THEN spread ELSE 1 END AS z FROM g JOIN c ON c.k = {by}),
m AS (SELECT k, center, spread, count(*) AS n, count(DISTINCT n_orig) AS d, {_MOMENTS} FROM x GROUP BY k, center, spread)
SELECT k AS {by}, n, round(center, 6) AS center, round(spread, 6) AS spread,
       {", ".join(f"CASE WHEN d > 3 THEN round({c}, 6) END AS c{k}" for k, c in enumerate(rp.trend_sql(3)))} FROM m"""


@register("r11_cubic_trend", _trend_oracle("seed"))
def r11_cubic_trend(spark, sf):
    """The cubic trend of gain over group size, per seed."""
    t = rp.polynomial_trend(fx.subgroup_gains(spark, sf), "n_orig", "gain", ["seed"])
    return t.select("seed", "n", r6("center"), r6("spread"), *[r6(f"c{k}") for k in range(4)])


@register("r12_mean_ci95", f"""
SELECT source, round(avg(score), 6) AS mean, round(1.96 * stddev_pop(score) / sqrt(count(score)), 6) AS ci95
FROM ({F8}) r GROUP BY source HAVING source LIKE '%curated%' OR source LIKE '%tvae%'""")
def r12_mean_ci95(spark, sf):
    out = rp.mean_ci95(fx.results(spark, sf), ["source"], contains=["curated", "tvae"])
    return out.select("source", r6("mean"), r6("ci95"))


@register("r13_compare_on_top", f"""
WITH a AS ({fx.f9_sql(0)}), b AS ({fx.f9_sql(1)}),
top AS (SELECT seed, subgroup FROM (SELECT seed, subgroup, row_number() OVER (PARTITION BY seed ORDER BY gain DESC, subgroup) AS rk
        FROM a) x WHERE rk <= 5)
SELECT b.seed, b.subgroup, b.n_orig, b.n_gen FROM b WHERE (b.seed, b.subgroup) IN (SELECT seed, subgroup FROM top)""")
def r13_compare_on_top(spark, sf):
    """The second generator on the five subgroups of each seed where the first one gains most."""
    a, b = (fx.subgroup_gains(spark, sf, g) for g in (0, 1))
    return rp.compare_on_top(a, b, 5, F.col("gain").desc()).select("seed", "subgroup", "n_orig", "n_gen")


@register("r13_deep_dive", f"""
WITH g AS ({F9}),
s AS (SELECT subgroup, avg(gain) AS mu, stddev_pop(gain) AS sd FROM g GROUP BY subgroup),
j AS (SELECT g.*, CASE WHEN sd = 0 THEN true ELSE abs(gain - mu) / sd < 2 END AS keep FROM g JOIN s USING (subgroup)),
a AS (SELECT subgroup, max(CAST(keep AS INTEGER)) AS any_keep FROM j GROUP BY subgroup),
m AS (SELECT subgroup, avg(gain) AS mean, stddev_samp(gain) / sqrt(count(gain)) AS sem FROM j JOIN a USING (subgroup)
      WHERE keep OR any_keep = 0 GROUP BY subgroup),
r AS (SELECT subgroup, min(n_orig) AS min_n_orig, max(n_orig) AS max_n_orig, min(n_gen) AS min_n_gen, max(n_gen) AS max_n_gen FROM g GROUP BY subgroup)
SELECT subgroup, concat(CAST(round(mean * 100, 2) AS VARCHAR), '+-', coalesce(CAST(round(sem * 100, 2) AS VARCHAR), 'nan')) AS cell,
       min_n_orig, max_n_orig, min_n_gen, max_n_gen
FROM m JOIN r USING (subgroup) ORDER BY cell DESC, subgroup LIMIT 5""")
def r13_deep_dive(spark, sf):
    return rp.deep_dive(fx.subgroup_gains(spark, sf), 5)


@register("r14_pca_map")
def r14_pca_map(spark, sf):
    return rp.pca_map(fx.real_syn(spark, sf), fx.FEATURES).groupBy("source").agg(
        F.count("*").alias("n"), r6(F.avg("x1"), "mean_x1"))


@register("r15_ablation_compare", f"""
SELECT dataset, seed, metric, ns, {', '.join(f"round(coalesce(max(CASE WHEN source = '{m}' THEN score END), 0), 6) AS {m}" for m in ABLATION)}
FROM ({F8}) r GROUP BY dataset, seed, metric, ns""")
def r15_ablation_compare(spark, sf):
    w = rp.long_to_wide(fx.results(spark, sf), CELLS, "source", ABLATION, "score")
    return w.select(*CELLS, *[r6(m) for m in ABLATION])
