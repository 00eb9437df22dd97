"""Checked queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.plans.catalog import r6, register
from rowsift.session import scratch_path, table
from rowsift.sources import fixtures as fx
from rowsift.sources import registry as reg

F1 = fx.F1_SQL
F4 = fx.F4_SQL
F8 = fx.F8_SQL

_LI_SCHEMA = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
              "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
              "l_shipdate TIMESTAMP_NTZ")


@register("s1_csv_scan", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
       l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate FROM lineitem""")
def s1_csv_scan(spark, sf):
    """lineitem, all columns -> header CSV in shared storage -> declared-schema CSV scan."""
    path = scratch_path(spark, "lineitem-csv")
    table(spark, sf, "lineitem").write.option("header", True).csv(path)
    back = reg.read_csv(spark, path, schema=_LI_SCHEMA)
    return back.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6("l_quantity"), r6("l_extendedprice"), r6("l_discount"),
                       r6("l_tax"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("l_shipdate"))


@register("s2_fallback_path", "SELECT count(*) AS n FROM lineitem")
def s2_fallback_path(spark, sf):
    df = reg.read_first(spark, [f"{sf}/missing/lineitem.parquet", f"{sf}/lineitem.parquet"])
    return df.agg(F.count("*").alias("n"))


@register("s3_registry_load", f"""
SELECT rid, l_quantity, l_extendedprice, l_discount, l_tax, y FROM ({F1}) f1""")
def s3_registry_load(spark, sf):
    def prepare(df):
        f1 = df.select(fx.rid_col().alias("rid"), *fx.FEATURES)
        clean = ((F.col("l_extendedprice") * (1 - F.col("l_discount"))) > 30000).cast("int")
        flip = (F.substring(F.md5(F.concat("rid", F.lit("|f"))), 1, 2) < "1a").cast("int")
        return f1.withColumn("y", ((clean + flip) % 2).cast("int"))

    reg.register_table_dataset("lineitem_noisy", sf, "lineitem", "y", prepare=prepare)
    return reg.load_dataset(spark, "lineitem_noisy")


@register("s3_balanced_load", f"""
SELECT rid, l_quantity, l_tax, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat(rid, '|', '42')), rid) AS n
  FROM (SELECT {fx._RID} AS rid, * FROM lineitem) l) r WHERE n <= 500""")
def s3_balanced_load(spark, sf):
    """A data set whose specification balances its classes: half of 1,000 rows a class, by replayable order."""
    reg.register_dataset(reg.DatasetSpec("lineitem_balanced", f"{sf.rstrip('/')}/lineitem.parquet", "l_returnflag", fmt="parquet",
                                         prepare=lambda df: df.withColumn("rid", fx.rid_col()), features=("rid", "l_quantity", "l_tax"),
                                         per_class=1_000))
    return reg.load_dataset(spark, "lineitem_balanced", prop=0.5, key="rid")


@register("s4_s5_bundles", f"""
SELECT dataset, ns, seed, source, metric, round(score, 6) AS score FROM ({F8}) r
WHERE dataset IN ('click', 'view') AND ns = 20""")
def s4_s5_bundles(spark, sf):
    """Write the results grid partitioned by dataset/ns/seed/source; read back two datasets at ns=20
    (partition pruning: only those directories are listed and scanned)."""
    path = scratch_path(spark, "bundles")
    reg.save_bundle(fx.results(spark, sf), path)
    back = reg.load_bundles(spark, path, dataset=["click", "view"], ns=20)
    return back.select("dataset", F.col("ns").cast("int"), F.col("seed").cast("int"), "source", "metric", r6("score"))


@register("s6_tag_and_union", f"""
SELECT source, rid, y AS target FROM ({F4}) f4""")
def s6_tag_and_union(spark, sf):
    f4 = fx.real_syn(spark, sf)
    frames = {s: f4.where(F.col("source") == s).drop("source").select("rid", "y") for s in ("real", "syn_a", "syn_b")}
    return reg.tag_and_union(frames, label="y").select("source", "rid", "target")
