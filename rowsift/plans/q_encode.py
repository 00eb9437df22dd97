"""Checked queries for projections and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsift.functions import encode as enc
from rowsift.plans.catalog import r6, register
from rowsift.session import table
from rowsift.sources import fixtures as fx

F1 = fx.F1_SQL
F4 = fx.F4_SQL

# Fixed values used by the fixture encodings below.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITY_MAP = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
TYPE_GROUPS = [("small", ["SMALL", "MEDIUM"]), ("large", ["LARGE"]), ("promo", ["PROMO"])]


@register("p1_feature_label_split", f"SELECT rid, l_quantity, l_extendedprice, l_discount, l_tax, y FROM ({F1}) f1")
def p1_feature_label_split(spark, sf):
    return enc.split_features_label(fx.labelled(spark, sf), "y", fx.FEATURES, keys=["rid"])


@register("p2_positional_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def p2_positional_projection(spark, sf):
    # positions 0, 2, 3, 5 then drop the priority (label = position 0 kept first)
    return enc.select_positions(table(spark, sf, "orders"), [0, 2, 3, 5], drop=["o_orderpriority"])


@register("p3_drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def p3_drop_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    return enc.drop_columns(li, ["l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                 "l_shipdate"])


@register("p4_rename", "SELECT l_orderkey, l_linenumber, l_returnflag AS y FROM lineitem")
def p4_rename(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return enc.rename(li, {"l_returnflag": "y"})


_ONEHOT_SQL = ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"seg_{i + 1}.0\"" for i, s in enumerate(SEGMENTS))


@register("p5_onehot_to_ordinal", f"""
SELECT c_custkey, coalesce({', '.join(f'CASE WHEN "seg_{i + 1}.0" = 1 THEN {i + 1} END' for i in range(5))}) AS segment
FROM (SELECT c_custkey, {_ONEHOT_SQL} FROM customer) c""")
def p5_onehot_to_ordinal(spark, sf):
    c = table(spark, sf, "customer")
    onehot = c.select("c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg_{i + 1}.0")
                                     for i, s in enumerate(SEGMENTS)])
    return onehot.select("c_custkey", enc.onehot_to_ordinal([f"seg_{i + 1}.0" for i in range(5)]).alias("segment"))


@register("p6_value_map", f"""
SELECT o_orderkey, CAST(CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY_MAP.items())} END AS DOUBLE) AS prio
FROM orders""")
def p6_value_map(spark, sf):
    o = table(spark, sf, "orders")
    # unmatched -> NULL; emitted as DOUBLE so NULL compares as NaN in both engines
    return o.select("o_orderkey", enc.map_values(F.col("o_orderpriority"), PRIORITY_MAP).cast("double").alias("prio"))


@register("p7_value_replace", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' ELSE o_orderstatus END AS status FROM orders""")
def p7_value_replace(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", enc.replace_values(F.col("o_orderstatus"), ["F", "O"], "done").alias("status"))


@register("p8_two_way_bucket", """
SELECT c.c_custkey, CASE WHEN n.n_name = 'NATION_24' THEN 'US' ELSE 'Non-US' END AS country
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def p8_two_way_bucket(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")  # dimension table: 25 rows
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select("c_custkey", enc.two_way(F.col("n_name"), "NATION_24").alias("country"))


@register("p9_category_merge", """
SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'small' WHEN p_type IN ('LARGE') THEN 'large'
                       WHEN p_type IN ('PROMO') THEN 'promo' ELSE 'other' END AS type_group FROM part""")
def p9_category_merge(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", enc.merge_categories(F.col("p_type"), TYPE_GROUPS, "other").alias("type_group"))


@register("p10_sign_indicator", """
SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1 WHEN c_acctbal = 0 THEN 0 ELSE c_acctbal END, 6) AS acct
FROM customer""")
def p10_sign_indicator(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", r6(enc.sign_indicator(F.col("c_acctbal")), "acct"))


@register("p11_ordinal_encode", f"""
SELECT o_orderkey, CAST(list_position([{', '.join(f"'{v}'" for v in PRIORITY_ORDER)}], o_orderpriority) - 1 AS INTEGER) AS prio_ord
FROM orders""")
def p11_ordinal_encode(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", enc.ordinal_encode(F.col("o_orderpriority"), PRIORITY_ORDER).cast("int").alias("prio_ord"))


@register("p12_nominal_codes", """
SELECT p_partkey, CAST(coalesce(dense_rank() OVER (ORDER BY p_brand) - 1, -1) AS INTEGER) AS p_brand FROM part""")
def p12_nominal_codes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return enc.nominal_codes(p, "p_brand")


@register("p13_binary_encode", """
SELECT c_custkey, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_machinery,
       CAST(c_nationkey NOT IN (0, 1) AS INTEGER) AS nation_not01 FROM customer""")
def p13_binary_encode(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", enc.binary_equals(F.col("c_mktsegment"), "MACHINERY").alias("is_machinery"),
                    enc.binary_not_in(F.col("c_nationkey"), [0, 1]).alias("nation_not01"))


@register("p14_dict_lookup", f"""
SELECT c_custkey, CASE c_mktsegment {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS))} END AS seg_code
FROM customer""")
def p14_dict_lookup(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", enc.lookup(F.col("c_mktsegment"), {s: i for i, s in enumerate(SEGMENTS)}).alias("seg_code"))


@register("p15_anonymise_restore", f"""
SELECT rid, round(l_quantity + l_tax, 6) AS mixed, y FROM ({F1}) f1""")
def p15_anonymise_restore(spark, sf):
    df = fx.labelled(spark, sf).select("rid", "l_quantity", "l_tax", "y")
    anon, original = enc.anonymise(df, "y")  # rid, l_quantity, l_tax -> feat_0..feat_2, y -> target
    work = anon.withColumn("feat_1", F.col("feat_1") + F.col("feat_2"))  # positional work on anonymous names
    back = enc.restore_names(work, original)
    return back.select("rid", r6("l_quantity", "mixed"), "y")


@register("p16_select_like_example", f"""
SELECT l_tax, rid, NULL::VARCHAR AS missing_col FROM ({F1}) f1""")
def p16_select_like_example(spark, sf):
    return enc.select_like(fx.labelled(spark, sf), ["l_tax", "rid", "missing_col"]).select(
        "l_tax", "rid", F.col("missing_col").cast("string"))


@register("p17_null_fill", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS target FROM orders""")
def p17_null_fill(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", enc.fill_from(F.nullif(F.col("o_orderstatus"), F.lit("P")),
                                                F.col("o_orderpriority")).alias("target"))


_P18_RAW = ("CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'x' || CAST(o_custkey AS VARCHAR) "
            "WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE CAST(o_custkey * 100 AS VARCHAR) END")


@register("p18_label_repair", f"""
SELECT o_orderkey, label FROM (
  SELECT o_orderkey, CASE WHEN v > 1 AND v < 50000 THEN 0.0 WHEN v >= 50000 THEN 1.0 ELSE v END AS label
  FROM (SELECT o_orderkey, TRY_CAST({_P18_RAW} AS DOUBLE) AS v FROM orders) a) b
WHERE label IS NOT NULL""")
def p18_label_repair(spark, sf):
    o = table(spark, sf, "orders")
    m = F.col("o_orderkey") % 5
    raw = (F.when(m == 0, F.col("o_custkey").cast("string"))
            .when(m == 1, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
            .when(m == 2, F.lit("1")).when(m == 3, F.lit("0"))
            .otherwise((F.col("o_custkey") * 100).cast("string")))
    out = o.select("o_orderkey", enc.repair_label(raw).alias("label"))
    return out.na.drop(subset=["label"])


_STD_SQL = ", ".join(
    f"round((l.{c} - s.mu_{c}) / CASE WHEN s.sd_{c} = 0 THEN 1 ELSE s.sd_{c} END, 6) AS {c}" for c in fx.FEATURES)
_STD_AGG = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in fx.FEATURES)


@register("p19_standardise", f"""
SELECT l.rid, l.source, {_STD_SQL} FROM ({F4}) l CROSS JOIN (SELECT {_STD_AGG} FROM ({F4}) r WHERE source = 'real') s""")
def p19_standardise(spark, sf):
    f4 = fx.real_syn(spark, sf)
    out = enc.standardise(f4, fx.FEATURES, ref=f4.where(F.col("source") == "real"))
    return out.select("rid", "source", *[r6(c) for c in fx.FEATURES])


_MM_SQL = ", ".join(
    f"round(CASE WHEN s.hi_{c} = s.lo_{c} THEN 0.0 ELSE (l.{c} - s.lo_{c}) / (s.hi_{c} - s.lo_{c}) END, 6) AS {c}"
    for c in fx.FEATURES)
_MM_AGG = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in fx.FEATURES)


@register("p20_minmax_scale", f"""
SELECT l.rid, l.source, {_MM_SQL} FROM ({F4}) l CROSS JOIN (SELECT {_MM_AGG} FROM ({F4}) r) s""")
def p20_minmax_scale(spark, sf):
    f4 = fx.real_syn(spark, sf)
    return enc.minmax_scale(f4, fx.FEATURES).select("rid", "source", *[r6(c) for c in fx.FEATURES])
