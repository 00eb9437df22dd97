"""Checked queries for distribution metrics (Q0-Q11), SMOTE (O1) and the generator registry (O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.operators import distance as dst
from rowsift.operators import oversample as ov
from rowsift.operators import quality as qm
from rowsift.plans.catalog import r6, register
from rowsift.sources import fixtures as fx

F4 = fx.F4_SQL
F5 = fx.F5_SQL
COLS = fx.FEATURES

_REAL5 = "substring(md5(concat(CAST(vec_id AS VARCHAR), '|', 'r')), 1, 1) < '8'"


def _f4(spark, sf, src):
    return fx.real_syn(spark, sf).where(F.col("source") == src)


def _f5(spark, sf, real: bool):
    v = fx.vectors(spark, sf)
    cond = F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("|r"))), 1, 1) < "8"
    return v.where(cond if real else ~cond)


_LONG = f"""
SELECT source, col, v FROM (UNPIVOT (SELECT source, {', '.join(COLS)} FROM ({F4}) f4)
                             ON {', '.join(COLS)} INTO NAME col VALUE v) u"""

_HIST = f"""
WITH l AS ({_LONG}),
rng AS (SELECT col, min(v) AS lo, max(v) AS hi FROM l WHERE source = 'real' GROUP BY col),
b AS (SELECT l.source, l.col, CASE WHEN hi = lo THEN 0 ELSE CAST(least(greatest(floor((v - lo) / (hi - lo) * 10), 0), 9) AS INTEGER) END AS bin
      FROM l JOIN rng ON l.col = rng.col WHERE l.source IN ('real', 'syn_b')),
c AS (SELECT col, bin, sum(CAST(source = 'real' AS BIGINT)) AS n_real, sum(CAST(source = 'syn_b' AS BIGINT)) AS n_syn FROM b GROUP BY col, bin)
SELECT col, bin, n_real, n_syn, n_real / sum(n_real) OVER (PARTITION BY col) AS p, n_syn / sum(n_syn) OVER (PARTITION BY col) AS q FROM c"""


def _hist(spark, sf):
    return qm.histograms(_f4(spark, sf, "real"), _f4(spark, sf, "syn_b"), COLS)


@register("q3_inverse_kl", f"""
SELECT col, round(1 / (1 + coalesce(sum(CASE WHEN p > 0 THEN p * ln(p / (q + 1e-10)) END), 0)), 6) AS score
FROM ({_HIST}) h GROUP BY col""")
def q3_inverse_kl(spark, sf):
    return qm.inverse_kl(_hist(spark, sf)).select("col", r6("score"))


@register("q4_jensen_shannon", f"""
SELECT col, round(js, 6) AS divergence, round(sqrt(greatest(js, 0)), 6) AS distance FROM (
  SELECT col, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js
  FROM ({_HIST}) h GROUP BY col) j""")
def q4_jensen_shannon(spark, sf):
    return qm.jensen_shannon(_hist(spark, sf)).select("col", r6("divergence"), r6("distance"))


def chi_sql(hist: str) -> str:
    """Empty real bins go to the next lower held one; the p-value is the power series of the incomplete gamma function."""
    return f"""
WITH s AS (SELECT *, coalesce(max(CASE WHEN p > 0 THEN bin END) OVER (PARTITION BY col ORDER BY bin),
                              min(CASE WHEN p > 0 THEN bin END) OVER (PARTITION BY col)) AS slot FROM ({hist}) h),
m AS (SELECT col, slot, sum(p) AS p, sum(n_syn) AS n_syn, sum(CASE WHEN p > 0 THEN 0 ELSE n_syn END) AS beyond FROM s GROUP BY col, slot),
e AS (SELECT *, p * sum(n_syn) OVER (PARTITION BY col) AS e FROM m),
c AS (SELECT col, sum((n_syn - e) * (n_syn - e) / e) AS x, count(*) - 1 AS dof, CAST(sum(beyond) AS BIGINT) AS outside FROM e WHERE e > 0 GROUP BY col),
g AS (SELECT col, sum(exp((dof / 2.0 + k) * ln(x / 2) - x / 2 - lgamma(dof / 2.0 + k + 1))) AS lower
      FROM (SELECT *, unnest(range(0, CAST(x / 2 + 12 * sqrt(x / 2) AS BIGINT) + 60)) AS k FROM c WHERE x > 0) t GROUP BY col)
SELECT c.col, round(x, 6) AS statistic, dof, outside,
       CASE WHEN dof > 0 THEN round(greatest(1 - coalesce(lower, 0), 0), 6) END AS p_value FROM c LEFT JOIN g ON g.col = c.col"""


@register("q6_chi_squared", chi_sql(_HIST))
def q6_chi_squared(spark, sf):
    return qm.chi_squared(_hist(spark, sf)).select("col", r6("statistic"), "dof", "outside", r6("p_value"))


_GAP = f"""
WITH l AS (SELECT * FROM ({_LONG}) x WHERE source IN ('real', 'syn_b')),
n AS (SELECT col, sum(CAST(source = 'real' AS DOUBLE)) AS nr, sum(CAST(source = 'syn_b' AS DOUBLE)) AS ns FROM l GROUP BY col),
g AS (SELECT l.col, v, sum(CAST(source = 'real' AS DOUBLE)) / max(nr) - sum(CAST(source = 'syn_b' AS DOUBLE)) / max(ns) AS wt
      FROM l JOIN n ON l.col = n.col GROUP BY l.col, v)
SELECT col, v, sum(wt) OVER (PARTITION BY col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
       lead(v) OVER (PARTITION BY col ORDER BY v) AS next_v FROM g"""


@register("q5_kolmogorov_smirnov", f"""
SELECT col, round(max(abs(cum)), 6) AS statistic, round(1 - max(abs(cum)), 6) AS score FROM ({_GAP}) g GROUP BY col""")
def q5_kolmogorov_smirnov(spark, sf):
    ks = qm.kolmogorov_smirnov(_f4(spark, sf, "real"), _f4(spark, sf, "syn_b"), COLS)
    return ks.select("col", r6("statistic"), r6("score"))


@register("q8_wasserstein_1d", f"""
SELECT col, round(sum(abs(cum) * coalesce(next_v - v, 0)), 6) AS distance FROM ({_GAP}) g GROUP BY col""")
def q8_wasserstein_1d(spark, sf):
    return qm.wasserstein_1d(_f4(spark, sf, "real"), _f4(spark, sf, "syn_b"), COLS).select("col", r6("distance"))


@register("q7_mmd_linear", f"""
SELECT 'mmd_linear' AS metric, round({' + '.join(f'power(avg(CASE WHEN source = {chr(39)}real{chr(39)} THEN {c} END) - avg(CASE WHEN source = {chr(39)}syn_b{chr(39)} THEN {c} END), 2)' for c in COLS)}, 6) AS score
FROM ({F4}) f4""")
def q7_mmd_linear(spark, sf):
    return qm.mmd_linear(_f4(spark, sf, "real"), _f4(spark, sf, "syn_b"), COLS).select("metric", r6("score"))


@register("q7_mmd_rbf", f"""
WITH v AS (SELECT embedding, {_REAL5} AS is_real FROM ({F5}) f5),
k AS (SELECT a.is_real AS p, b.is_real AS q, avg(exp(-power(list_distance(a.embedding, b.embedding), 2))) AS k FROM v a, v b GROUP BY ALL)
SELECT 'mmd_rbf' AS metric, round(max(CASE WHEN p AND q THEN k END) + max(CASE WHEN NOT p AND NOT q THEN k END)
       - 2 * max(CASE WHEN p AND NOT q THEN k END), 6) AS score FROM k""")
def q7_mmd_rbf(spark, sf):
    return qm.mmd_rbf(_f5(spark, sf, True), _f5(spark, sf, False), "embedding").select("metric", r6("score"))


@register("q7_mmd_rbf_rff")
def q7_mmd_rbf_rff(spark, sf):
    real, syn = _f4(spark, sf, "real"), _f4(spark, sf, "syn_b")
    from rowsift.functions.encode import minmax_scale
    both = minmax_scale(real.unionByName(syn), COLS)
    return qm.mmd_rbf_rff(both.where(F.col("source") == "real"), both.where(F.col("source") == "syn_b"), COLS)


# ---------------------------------------------------------------- Q10 Kaplan-Meier on events
_KM_SQL = """
WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS s, floor(value) AS t,
                  CAST(event_type = 'error' AS DOUBLE) AS d0 FROM events),
grid AS (SELECT DISTINCT t, s2.s FROM e, (SELECT 'a' AS s UNION ALL SELECT 'b') s2),
cnt AS (SELECT s, t, CAST(count(*) AS DOUBLE) AS c, sum(d0) AS d FROM e GROUP BY s, t),
f AS (SELECT g.s, g.t, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM grid g LEFT JOIN cnt USING (s, t)),
r AS (SELECT s, t, c, d, sum(c) OVER (PARTITION BY s) - sum(c) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + c AS at_risk FROM f),
k AS (SELECT s, t, exp(sum(CASE WHEN at_risk <= 0 THEN 0 WHEN d >= at_risk THEN -1e300 ELSE ln(1 - d / at_risk) END)
                      OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS surv FROM r)
SELECT round(avg(abs(a.surv - b.surv)), 6) AS distance FROM k a JOIN k b ON a.t = b.t AND a.s = 'a' AND b.s = 'b'"""


@register("q10_km_distance", _KM_SQL)
def q10_km_distance(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.floor("value").alias("t"), (F.col("event_type") == "error").cast("double").alias("e"))
    return qm.km_distance(ev, "t", "e", "a", "b").select(r6("distance"))


# ---------------------------------------------------------------- vector metrics on embeddings
_V = f"(SELECT *, {_REAL5} AS is_real FROM ({F5}) f5)"
_PAIRS_RR = f"""SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.embedding, b.embedding) AS d
FROM {_V} a JOIN {_V} b ON a.is_real = b.is_real AND a.vec_id <> b.vec_id"""


@register("q11_knn", f"""
SELECT q AS vec_id, r AS nb_id, rank, round(d, 6) AS d FROM (
  SELECT q, r, d, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rank FROM ({_PAIRS_RR}) p) x WHERE rank <= 5""")
def q11_knn(spark, sf):
    out = None
    for real in (True, False):
        v = _f5(spark, sf, real)
        k = dst.knn(v, v.withColumnRenamed("vec_id", "nb_id"), 5, "vec_id", "nb_id", "embedding",
                    exclude_self=True, n_pivots=16)
        out = k if out is None else out.unionByName(k)
    return out.select("vec_id", "nb_id", F.col("rank").cast("long").alias("rank"), r6("d"))


_PRDC_SQL = f"""
WITH v AS {_V},
pr AS ({_PAIRS_RR}),
rad AS (SELECT q AS id, d AS r FROM (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM pr) x WHERE rk = 5),
x AS (SELECT v.vec_id, v.embedding, rad.r FROM v JOIN rad ON v.vec_id = rad.id WHERE v.is_real),
y AS (SELECT v.vec_id, v.embedding, rad.r FROM v JOIN rad ON v.vec_id = rad.id WHERE NOT v.is_real),
xy AS (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.embedding, y.embedding) AS d, x.r AS rx, y.r AS ry FROM x, y)
SELECT 'precision' AS metric, round(count(DISTINCT CASE WHEN d < rx THEN j END) / (SELECT count(*) FROM y), 6) AS score FROM xy
UNION ALL SELECT 'recall', round(count(DISTINCT CASE WHEN d < ry THEN i END) / (SELECT count(*) FROM x), 6) FROM xy
UNION ALL SELECT 'density', round(sum(CASE WHEN d < rx THEN 1 ELSE 0 END) / (5.0 * (SELECT count(*) FROM y)), 6) FROM xy
UNION ALL SELECT 'coverage', round(sum(CASE WHEN mind < rx THEN 1 ELSE 0 END) / (SELECT count(*) FROM x), 6)
  FROM (SELECT i, min(d) AS mind, max(rx) AS rx FROM xy GROUP BY i) c"""


@register("q1_prdc", _PRDC_SQL)
def q1_prdc(spark, sf):
    out = qm.prdc(_f5(spark, sf, True), _f5(spark, sf, False), "vec_id", "embedding", k=5, n_pivots=16)
    return out.select("metric", r6("score"))


@register("q9_nearest_synthetic_distance", f"""
WITH v AS {_V},
nn AS (SELECT x.vec_id, min(list_distance(x.embedding, y.embedding)) AS d FROM v x, v y
       WHERE x.is_real AND NOT y.is_real GROUP BY x.vec_id)
SELECT round(avg(CASE WHEN hi = lo THEN 0 ELSE (d - lo) / (hi - lo) END), 6) AS score
FROM nn, (SELECT min(d) AS lo, max(d) AS hi FROM nn) s""")
def q9_nearest_synthetic_distance(spark, sf):
    return qm.nearest_synthetic_distance(_f5(spark, sf, True), _f5(spark, sf, False), "vec_id", "embedding",
                                         n_pivots=16).select(r6("score"))


_ALPHA_SQL = f"""
WITH v AS {_V},
c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM v GROUP BY is_real)),
m AS (SELECT vec_id, embedding, is_real FROM (SELECT *, row_number() OVER (PARTITION BY is_real ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '|42')), vec_id) AS rk FROM v)
      WHERE rk <= (SELECT n FROM c)),
e AS (SELECT is_real, i, avg(x) AS x FROM (SELECT is_real, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM m) GROUP BY is_real, i),
ctr AS (SELECT is_real AS c_real, list(x ORDER BY i) AS center FROM e GROUP BY is_real),
r AS (SELECT is_real, c_real, list_distance(embedding, center) AS r FROM m, ctr),
q AS (SELECT c_real, unnest([i / 29.0 FOR i IN range(30)]) AS a, unnest(quantile_cont(r, [i / 29.0 FOR i IN range(30)])) AS radius FROM r WHERE is_real = c_real GROUP BY c_real),
p AS (SELECT q.c_real, a, avg(CAST(r <= radius AS DOUBLE)) AS inside FROM q JOIN r ON r.c_real = q.c_real AND r.is_real <> r.c_real GROUP BY q.c_real, a),
d AS (SELECT c_real, 1 - 2 * sum(abs(inside - a)) / 30 AS score FROM p GROUP BY c_real),
rr AS (SELECT a.vec_id AS i, min(list_distance(a.embedding, b.embedding)) AS r1 FROM m a, m b
       WHERE a.is_real AND b.is_real AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
sr AS (SELECT j, i, d FROM (SELECT y.vec_id AS j, x.vec_id AS i, list_distance(y.embedding, x.embedding) AS d,
              row_number() OVER (PARTITION BY y.vec_id ORDER BY list_distance(y.embedding, x.embedding), x.vec_id) AS rk
       FROM m y, m x WHERE NOT y.is_real AND x.is_real) z WHERE rk = 1)
SELECT CASE WHEN c_real THEN 'delta_precision_alpha' ELSE 'delta_coverage_beta' END AS metric, round(score, 6) AS score FROM d
UNION ALL SELECT 'authenticity', round(avg(CAST(rr.r1 < sr.d AS DOUBLE)), 6) FROM sr JOIN rr ON sr.i = rr.i"""


@register("q2_alpha_precision", _ALPHA_SQL)
def q2_alpha_precision(spark, sf):
    out = qm.alpha_precision(_f5(spark, sf, True), _f5(spark, sf, False), "vec_id", "embedding", n_pivots=16)
    return out.select("metric", r6("score"))


@register("q2_authenticity", f"""
WITH v AS {_V},
rr AS (SELECT a.vec_id AS i, min(list_distance(a.embedding, b.embedding)) AS r1 FROM v a, v b
       WHERE a.is_real AND b.is_real AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
sr AS (SELECT j, i, d FROM (SELECT y.vec_id AS j, x.vec_id AS i, list_distance(y.embedding, x.embedding) AS d,
              row_number() OVER (PARTITION BY y.vec_id ORDER BY list_distance(y.embedding, x.embedding), x.vec_id) AS rk
       FROM v y, v x WHERE NOT y.is_real AND x.is_real) z WHERE rk = 1)
SELECT round(avg(CAST(rr.r1 < sr.d AS DOUBLE)), 6) AS authenticity FROM sr JOIN rr ON sr.i = rr.i""")
def q2_authenticity(spark, sf):
    real, syn = _f5(spark, sf, True), _f5(spark, sf, False)
    r1 = dst.kth_distance(real, "vec_id", 1, "embedding", 16).withColumnRenamed("radius", "r1")
    nn = dst.knn(syn.withColumnRenamed("vec_id", "_sid"), real, 1, "_sid", "vec_id", "embedding", n_pivots=16)
    return nn.join(r1, "vec_id").agg(r6(F.avg((F.col("r1") < F.col("d")).cast("double")), "authenticity"))


_Q0_SQL = f"""
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS x, CASE WHEN {_REAL5} THEN NULL ELSE 'gen' || (label % 3) END AS s FROM ({F5}) f5),
r AS (SELECT id, x FROM v WHERE s IS NULL), y AS (SELECT * FROM v WHERE s IS NOT NULL), n AS (SELECT s, count(*) AS n FROM y GROUP BY s), nr AS (SELECT count(*) AS m FROM r),
rl AS (SELECT unnest(range(len(x))) AS col, unnest(x) AS v FROM r), yl AS (SELECT s, unnest(range(len(x))) AS col, unnest(x) AS v FROM y),
l AS (SELECT s, col, v, 0 AS cr, 1 AS cs FROM yl UNION ALL SELECT s, col, v, 1, 0 FROM rl, n),
rng AS (SELECT col, min(v) AS lo, max(v) AS hi FROM rl GROUP BY col),
hb AS (SELECT s, l.col, CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((v - lo) / (hi - lo) * 10), 0), 9) END AS bin, sum(cr) AS a, sum(cs) AS b
       FROM l JOIN rng ON rng.col = l.col GROUP BY ALL),
h AS (SELECT s, col, a / sum(a) OVER (PARTITION BY s, col) AS p, b / sum(b) OVER (PARTITION BY s, col) AS q FROM hb),
hs AS (SELECT s, col, 1 / (1 + sum(CASE WHEN p > 0 THEN p * ln(p / (q + 1e-10)) ELSE 0 END)) AS ikl,
         sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js
       FROM h GROUP BY s, col),
gv AS (SELECT s, col, v, sum(cr) AS cr, sum(cs) AS cs FROM l GROUP BY ALL),
gc AS (SELECT s, col, v, sum(cr) OVER w / (SELECT m FROM nr) - sum(cs) OVER w / (SELECT n FROM n WHERE n.s = gv.s) AS gap,
         lead(v) OVER (PARTITION BY s, col ORDER BY v) AS nx FROM gv WINDOW w AS (PARTITION BY s, col ORDER BY v)),
ws AS (SELECT s, col, sum(abs(gap) * coalesce(nx - v, 0)) AS d FROM gc GROUP BY s, col),
xy AS (SELECT y.s, r.id AS i, y.id AS j, list_distance(r.x, y.x) AS d FROM r, y),
rr AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM r a, r b),
yy AS (SELECT a.s, a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM y a JOIN y b ON a.s = b.s),
mm AS (SELECT n.s, (SELECT avg(exp(-d * d)) FROM rr) + (SELECT avg(exp(-d * d)) FROM yy WHERE yy.s = n.s) - 2 * (SELECT avg(exp(-d * d)) FROM xy WHERE xy.s = n.s) AS k FROM n),
br AS (SELECT i, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM rr WHERE i <> j) WHERE k = 5),
bs AS (SELECT i, d AS r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM yy WHERE i <> j) WHERE k = 5),
fj AS (SELECT s, j, count(*) FILTER (d < br.r) AS hits FROM xy JOIN br ON br.i = xy.i GROUP BY s, j),
fi AS (SELECT s, xy.i, bool_or(d < bs.r) AS hit FROM xy JOIN bs ON bs.i = xy.j GROUP BY s, xy.i),
nn AS (SELECT s, i, min(d) AS d FROM xy GROUP BY s, i),
ne AS (SELECT s, min(d) AS lo, max(d) AS hi FROM nn GROUP BY s),
rk AS (SELECT id, x, row_number() OVER (ORDER BY md5(id || '|42'), id) AS k FROM r), yk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(id || '|42'), id) AS k FROM y),
mr AS (SELECT n.s, 0 AS side, id, x FROM rk, n WHERE k <= least(n.n, (SELECT m FROM nr))), ms AS (SELECT n.s, 1 AS side, id, x FROM yk JOIN n ON n.s = yk.s WHERE k <= least(n.n, (SELECT m FROM nr))),
mx AS (SELECT * FROM mr UNION ALL SELECT * FROM ms),
ce AS (SELECT s, side, list(v ORDER BY i) AS c FROM (SELECT s, side, i, avg(v) AS v FROM (SELECT s, side, unnest(range(len(x))) AS i, unnest(x) AS v FROM mx) GROUP BY ALL) GROUP BY s, side),
dc AS (SELECT mx.s, ce.side AS inner_side, mx.side, list_distance(mx.x, ce.c) AS r FROM mx JOIN ce ON ce.s = mx.s),
qa AS (SELECT s, inner_side, unnest([i / 29.0 FOR i IN range(30)]) AS a, unnest(quantile_cont(r, [i / 29.0 FOR i IN range(30)])) AS q FROM dc WHERE side = inner_side GROUP BY s, inner_side),
pa AS (SELECT dc.s, dc.inner_side, a, avg(CAST(r <= q AS DOUBLE)) AS p FROM dc JOIN qa ON qa.s = dc.s AND qa.inner_side = dc.inner_side WHERE side <> dc.inner_side GROUP BY ALL),
da AS (SELECT s, inner_side, 1 - 2 * sum(abs(p - a)) / 30 AS score FROM pa GROUP BY ALL),
r1 AS (SELECT a.s, a.id AS i, min(list_distance(a.x, b.x)) AS r FROM mr a JOIN mr b ON a.s = b.s AND a.id <> b.id GROUP BY a.s, a.id),
nj AS (SELECT s, i, d FROM (SELECT ms.s, mr.id AS i, list_distance(mr.x, ms.x) AS d, row_number() OVER (PARTITION BY ms.s, ms.id ORDER BY list_distance(mr.x, ms.x), mr.id) AS k
       FROM ms JOIN mr ON mr.s = ms.s) WHERE k = 1),
o AS (SELECT 'inv_kl' AS metric, NULL AS component, s, avg(ikl) AS score FROM hs GROUP BY s UNION ALL SELECT 'jsd', NULL, s, avg(js) FROM hs GROUP BY s
  UNION ALL SELECT 'wasserstein', NULL, s, avg(d) FROM ws GROUP BY s UNION ALL SELECT 'mmd', NULL, s, k FROM mm
  UNION ALL SELECT 'prdc', 'precision', s, avg(CAST(hits > 0 AS DOUBLE)) FROM fj GROUP BY s UNION ALL SELECT 'prdc', 'density', s, sum(hits) / (5.0 * count(*)) FROM fj GROUP BY s
  UNION ALL SELECT 'prdc', 'recall', s, avg(CAST(hit AS DOUBLE)) FROM fi GROUP BY s
  UNION ALL SELECT 'prdc', 'coverage', s, avg(CAST(d < r AS DOUBLE)) FROM nn JOIN br ON br.i = nn.i GROUP BY s
  UNION ALL SELECT 'nearest_distance', NULL, nn.s, avg(CASE WHEN hi = lo THEN 0 ELSE (d - lo) / (hi - lo) END) FROM nn JOIN ne ON ne.s = nn.s GROUP BY nn.s
  UNION ALL SELECT 'alpha_precision', CASE inner_side WHEN 0 THEN 'delta_precision_alpha' ELSE 'delta_coverage_beta' END, s, score FROM da
  UNION ALL SELECT 'alpha_precision', 'authenticity', nj.s, avg(CAST(r < d AS DOUBLE)) FROM nj JOIN r1 ON r1.s = nj.s AND r1.i = nj.i GROUP BY nj.s)
SELECT metric, component, s AS source, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS error FROM o"""


@register("q0_quality_report", _Q0_SQL)
def q0_quality_report(spark, sf):
    """The seven metrics for three sources of vectors against the real ones, in one plan."""
    made = _f5(spark, sf, False).withColumn("source", F.concat(F.lit("gen"), (F.col("label") % 3).cast("string")))
    out = qm.quality_report(made, _f5(spark, sf, True), "embedding", "vec_id", n_pivots=16)
    return out.select("metric", "component", "source", r6("score"), "error")


# ---------------------------------------------------------------- O1 / O2
def _int_of(*parts: str) -> str:
    return f"CAST('0x' || substring(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


_SMOTE_SQL = f"""
WITH v AS ({F5}),
n AS (SELECT label, count(*) AS cnt, least(4, count(*) - 1) AS kk FROM v GROUP BY label),
g AS (SELECT label, cnt, kk, unnest(range((SELECT 2 * max(cnt) FROM n) - cnt)) AS s FROM n),
d AS (SELECT label, s, kk, {_int_of("'smote'", "label", "s", "42")} % cnt AS idx, {_int_of("'nb'", "label", "s", "42")} % greatest(kk, 1) + 1 AS rank,
             CAST('0x' || substring(md5(concat_ws('|', 'u', label, s, 42)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM g),
b AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '|42|', label)), vec_id) - 1 AS idx FROM v),
p AS (SELECT x.vec_id AS base_id, y.vec_id AS nb_id, y.embedding AS nx,
             row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.embedding, y.embedding), y.vec_id) AS rank
      FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id)
SELECT concat('smote|', d.label, '|', s) AS vec_id, d.label, b.vec_id AS base_id, nb_id, round(u, 6) AS u,
       round(list_sum(embedding) + u * (list_sum(nx) - list_sum(embedding)), 4) AS total
FROM d JOIN b ON b.label = d.label AND b.idx = d.idx LEFT JOIN p ON p.base_id = b.vec_id AND p.rank = d.rank"""

@register("o1_smote", _SMOTE_SQL)
def o1_smote(spark, sf):
    """Every synthetic row: its class, base row, neighbour, share and the sum of its vector."""
    out = ov.smote(fx.vectors(spark, sf), "vec_id", "embedding", "label", n=None, k=4, seed=42).where("is_synthetic = 1")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", "label", "base_id", "nb_id", r6("u"), F.round(total, 4).alias("total"))


@register("o2_generators", f"""
WITH t AS (SELECT rid, y, row_number() OVER (ORDER BY md5(concat(rid, '|42')), rid) - 1 AS idx, count(*) OVER () AS n FROM ({fx.F1_SQL}) f1)
SELECT 'Original' AS source, rid, y FROM t
UNION ALL SELECT 'bootstrap', rid, y FROM t JOIN (
  SELECT CAST(CAST(('0x' || substring(md5(concat_ws('|', 'boot', 0, id, '42')), 1, 15)) AS UBIGINT) % (SELECT max(n) FROM t) AS BIGINT) AS idx
  FROM range(0, 500) r(id)) d USING (idx)""")
def o2_generators(spark, sf):
    train = fx.labelled(spark, sf).select("rid", *COLS, "y")
    return ov.run_generators(train, ["bootstrap"], n=500, key="rid").select("source", "rid", "y")
