"""Checked queries for sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.functions.hashing import hex_threshold
from rowsift.operators import sampling as smp
from rowsift.plans.catalog import register
from rowsift.sources import fixtures as fx

F1 = fx.F1_SQL
F4 = fx.F4_SQL


def _h(seed):
    return f"md5(concat(rid, '|', '{seed}'))"


_D1_RN = f"row_number() OVER (PARTITION BY y ORDER BY {_h(42)}, rid)"


@register("d1_stratified_sample", f"""
SELECT rid, y FROM (SELECT rid, y, {_D1_RN} AS rn FROM ({F1}) f1) s WHERE rn <= 100""")
def d1_stratified_sample(spark, sf):
    return smp.stratified_sample(fx.labelled(spark, sf), "y", 100, "rid", seed=42).select("rid", "y")


@register("d1_remainder", f"""
SELECT rid, y FROM (SELECT rid, y, {_D1_RN} AS rn FROM ({F1}) f1) s WHERE rn > 100""")
def d1_remainder(spark, sf):
    _, rest = smp.stratified_split(fx.labelled(spark, sf), "y", 100, "rid", seed=42)
    return rest.select("rid", "y")


@register("d2_sample_and_split", f"""
SELECT rid, y, CASE WHEN rn <= 50 THEN 'sampled' ELSE 'remaining' END AS part
FROM (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {_h(100)}, rid) AS rn FROM ({F1}) f1) s""")
def d2_sample_and_split(spark, sf):
    s, r = smp.sample_and_split(fx.labelled(spark, sf), "y", 50, "rid", seed=100)
    return (s.select("rid", "y", F.lit("sampled").alias("part"))
            .unionByName(r.select("rid", "y", F.lit("remaining").alias("part"))))


_RANK = f"row_number() OVER (ORDER BY {_h(42)}, rid) - 1"


@register("d3_random_split", f"""
SELECT rid, CASE WHEN idx < n - CAST(ceil(0.5 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part
FROM (SELECT rid, {_RANK} AS idx, count(*) OVER () AS n FROM ({F1}) f1) s""")
def d3_random_split(spark, sf):
    a, b = smp.random_split(fx.labelled(spark, sf), "rid", test_size=0.5, seed=42)
    return a.select("rid", F.lit("train").alias("part")).unionByName(b.select("rid", F.lit("test").alias("part")))


@register("d3_hash_split", f"""
SELECT rid, CASE WHEN substring({_h(42)}, 1, 8) < '{hex_threshold(0.7)}' THEN 'train' ELSE 'test' END AS part
FROM ({F1}) f1""")
def d3_hash_split(spark, sf):
    a, b = smp.random_split(fx.labelled(spark, sf), "rid", test_size=0.3, seed=42, exact=False)
    return a.select("rid", F.lit("train").alias("part")).unionByName(b.select("rid", F.lit("test").alias("part")))


@register("d4_roles", f"""
WITH s AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {_h(42)}, rid) AS rn FROM ({F1}) f1),
rest AS (SELECT rid, row_number() OVER (ORDER BY {_h(42)}, rid) - 1 AS idx, count(*) OVER () AS n FROM s WHERE rn > 100)
SELECT rid, 'original' AS role FROM s WHERE rn <= 100
UNION ALL
SELECT rid, CASE WHEN idx < n - CAST(ceil(0.5 * n) AS BIGINT) THEN 'oracle' ELSE 'test' END FROM rest""")
def d4_roles(spark, sf):
    return smp.assign_roles(fx.labelled(spark, sf), "y", 100, "rid", seed=42).select("rid", "role")


@register("d5_fraction_sample", f"""
SELECT rid FROM ({F1}) f1 WHERE substring({_h(7)}, 1, 8) < '{hex_threshold(0.3)}'""")
def d5_fraction_sample(spark, sf):
    return smp.fraction_sample(fx.labelled(spark, sf), "rid", 0.3, seed=7).select("rid")


@register("d6_balanced_sample", f"""
SELECT rid, y, row_number() OVER (ORDER BY md5(concat(rid, '|', '42|shuffle')), rid) - 1 AS row_id
FROM (SELECT rid, y, {_D1_RN} AS rn FROM ({F1}) f1) s WHERE rn <= 100""")
def d6_balanced_sample(spark, sf):
    return smp.balanced_sample(fx.labelled(spark, sf), "y", 0.01, 10000, "rid", seed=42).select("rid", "y", "row_id")


@register("d7_bootstrap", f"""
WITH r AS (SELECT rid, {_RANK} AS idx, count(*) OVER () AS n FROM ({F1}) f1),
d AS (SELECT CAST(id // 500 AS INTEGER) AS iter, CAST(id % 500 AS INTEGER) AS draw FROM range(0, 1500) t(id))
SELECT d.iter, d.draw, r.rid FROM d JOIN r
  ON r.idx = CAST(CAST(('0x' || substring(md5(concat_ws('|', 'boot', d.iter, d.draw, '42')), 1, 15)) AS UBIGINT)
                  % (SELECT max(n) FROM r) AS BIGINT)""")
def d7_bootstrap(spark, sf):
    return smp.bootstrap(fx.labelled(spark, sf), "rid", 500, iterations=3, seed=42).select("iter", "draw", "rid")


def _compounding_sql(n: int, iterations: int) -> str:
    """Every iteration draws from the draws of the one before, by its own ranks."""
    ctes, pool = [], f"SELECT rid FROM ({F1}) f1"
    for it in range(iterations):
        ctes.append(f"""r{it} AS (SELECT rid, row_number() OVER (ORDER BY {_h(f"42|{it}")}, rid) - 1 AS idx, count(*) OVER () AS n FROM ({pool}) p),
b{it} AS (SELECT draw, rid FROM (SELECT CAST(id AS INTEGER) AS draw,
            CAST(CAST(('0x' || substring(md5(concat_ws('|', 'boot', 0, id, '42|{it}')), 1, 15)) AS UBIGINT) % (SELECT max(n) FROM r{it}) AS BIGINT) AS idx
          FROM range(0, {n}) t(id)) d JOIN r{it} USING (idx))""")
        pool = f"SELECT rid FROM b{it}"
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {it} AS iter, draw, rid FROM b{it}" for it in range(iterations))


@register("d8_compounding_bootstrap", _compounding_sql(300, 3))
def d8_compounding_bootstrap(spark, sf):
    return smp.bootstrap(fx.labelled(spark, sf), "rid", 300, iterations=3, seed=42, compounding=True).select("iter", "draw", "rid")


@register("d9_shuffle", f"SELECT rid, {_RANK} AS pos FROM ({F1}) f1")
def d9_shuffle(spark, sf):
    """The shuffle order as an exact distributed rank (no single-partition sort)."""
    return smp.hash_rank(fx.labelled(spark, sf), "rid", 42, "pos").select("rid", "pos")


@register("d10_size_match", f"""
WITH a AS (SELECT rid FROM ({F4}) f4 WHERE source = 'real'),
b AS (SELECT rid FROM ({F4}) f4 WHERE source = 'syn_a'),
big AS (SELECT rid, row_number() OVER (ORDER BY {_h(42)}, rid) - 1 AS idx FROM a)
SELECT 'syn_a' AS source, rid FROM b
UNION ALL SELECT 'real', rid FROM big WHERE idx < (SELECT count(*) FROM b)""")
def d10_size_match(spark, sf):
    f4 = fx.real_syn(spark, sf)
    a, b = smp.size_match(f4.where(F.col("source") == "real"), f4.where(F.col("source") == "syn_a"), "rid", 42)
    return a.select("source", "rid").unionByName(b.select("source", "rid"))


@register("c9_cap_per_source", f"""
SELECT source, rid FROM (SELECT source, rid,
  row_number() OVER (PARTITION BY source ORDER BY {_h(42)}, rid) AS rn FROM ({F4}) f4) s WHERE rn <= 1000""")
def c9_cap_per_source(spark, sf):
    return smp.cap_per_group(fx.real_syn(spark, sf), 1000, "rid", ["source"], seed=42).select("source", "rid")
