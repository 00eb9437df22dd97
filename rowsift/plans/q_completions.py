"""Checked queries for completions (G1-G10) and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowsift.operators import clean as cl
from rowsift.operators import completions as cp
from rowsift.operators import sampling as smp
from rowsift.plans.catalog import r6, register
from rowsift.sources import fixtures as fx

F1 = fx.F1_SQL
F3 = fx.F3_SQL
ORDER_SCHEMA = fx.ORDER_STRUCT
TARGETS = [f.name for f in ORDER_SCHEMA.fields]
KEYS = ["source", "iter", "choice", "frag_pos"]
_PAT = r"(\{[^{}]*\})"

# ---------------------------------------------------------------- SQL building blocks
_FRAGS_SQL = f"""
SELECT source, iter, choice, unnest(fr) AS frag, unnest(generate_series(0, len(fr) - 1)) AS frag_pos
FROM (SELECT source, iter, choice, regexp_extract_all(text, '{_PAT}', 1) AS fr FROM ({F3}) c) x"""

_VALID_SQL = f"""
SELECT source, iter, choice, len(fr) AS n_frags,
       coalesce(list_bool_and(list_transform(fr, lambda f: CASE WHEN json_valid(f) THEN json_type(f) = 'OBJECT' ELSE false END)), true) AS valid
FROM (SELECT source, iter, choice, regexp_extract_all(text, '{_PAT}', 1) AS fr FROM ({F3}) c) x"""

_PARSED_SQL = f"""
SELECT f.source, f.iter, f.choice, f.frag_pos, CASE WHEN json_valid(f.frag) THEN f.frag ELSE '{{}}' END AS frag
FROM ({_FRAGS_SQL}) f
JOIN ({_VALID_SQL}) v ON f.source = v.source AND f.iter = v.iter AND f.choice = v.choice
WHERE v.valid"""


def _kind(c):
    return f"json_type(frag, '$.{c}')"


def _text(c):
    return f"json_extract_string(frag, '$.{c}')"


def _conv_sql(c, dtype, int_strings="strict"):
    k, t = _kind(c), _text(c)
    if dtype == "bigint":
        if int_strings == "strict":
            s = rf"CASE WHEN regexp_full_match({t}, '\s*[+-]?\d+\s*') THEN TRY_CAST(trim({t}) AS BIGINT) END"
        else:
            s = f"CAST(trunc(TRY_CAST(trim({t}) AS DOUBLE)) AS BIGINT)"
        val = (f"CASE WHEN {k} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST(json_extract(frag, '$.{c}') AS DOUBLE)) AS BIGINT) "
               f"WHEN {k} = 'VARCHAR' THEN {s} "
               f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN {t} = 'true' THEN 1 ELSE 0 END END")
        return val, f"({val}) IS NOT NULL"
    if dtype == "double":
        val = (f"CASE WHEN {k} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(frag, '$.{c}') AS DOUBLE) "
               f"WHEN {k} = 'VARCHAR' THEN TRY_CAST(trim({t}) AS DOUBLE) "
               f"WHEN {k} = 'BOOLEAN' THEN CASE WHEN {t} = 'true' THEN 1.0 ELSE 0.0 END END")
        return val, f"(({val}) IS NOT NULL OR {k} IS NULL OR {k} = 'NULL')"
    val = f"CASE WHEN {k} IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN {t} END"
    return val, f"(({val}) IS NOT NULL OR {k} IS NULL OR {k} = 'NULL')"


_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
          "o_totalprice": "double", "o_orderpriority": "string"}


def _words(ws):
    return ", ".join("'" + w + "'" for w in ws)


def _placeholder_sql(words):
    return (f"EXISTS (SELECT 1 FROM json_each(frag) je WHERE je.type = 'VARCHAR' "
            f"AND json_extract_string(je.value, '$') IN ({_words(words)}))")


_LIST_SQL = "EXISTS (SELECT 1 FROM json_each(frag) je WHERE je.type = 'ARRAY')"


def _conform_sql(src_sql, int_strings="strict", select_extra=""):
    vals, oks = [], []
    for c in TARGETS:
        v, ok = _conv_sql(c, _TYPES[c], int_strings)
        vals.append(f"{v} AS {c}")
        oks.append(ok)
    return (f"SELECT source, iter, choice, frag_pos, {', '.join(vals)} {select_extra} FROM ({src_sql}) s "
            f"WHERE NOT {_LIST_SQL} AND " + " AND ".join(oks))


def _final(sql):
    return (f"SELECT source, iter, choice, frag_pos, o_orderkey, o_custkey, o_orderstatus, "
            f"round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM ({sql}) z")


def _parsed(spark, sf):
    return cp.parse_completions(fx.completions(spark, sf))


def _typed(df):
    return df.select(*KEYS, "o_orderkey", "o_custkey", "o_orderstatus", r6("o_totalprice"), "o_orderpriority")


# ---------------------------------------------------------------- G1 / G3
_BOOT_SQL = f"""
WITH r AS (SELECT rid, y, row_number() OVER (ORDER BY md5(concat(rid, '|', '42')), rid) - 1 AS idx,
                  count(*) OVER () AS n FROM ({F1}) f1),
d AS (SELECT CAST(id // 20 AS INTEGER) AS iter, CAST(id % 20 AS INTEGER) AS draw FROM range(0, 200) t(id))
SELECT d.iter, d.draw, r.rid, r.y FROM d JOIN r
  ON r.idx = CAST(CAST(('0x' || substring(md5(concat_ws('|', 'boot', d.iter, d.draw, '42')), 1, 15)) AS UBIGINT)
                  % (SELECT max(n) FROM r) AS BIGINT)"""

_SER_SQL = f"""SELECT iter, to_json(list({{'draw': draw, 'rid': rid, 'y': y}} ORDER BY draw)) AS data
FROM ({_BOOT_SQL}) b GROUP BY iter"""


def _batches(spark, sf):
    draws = smp.bootstrap(fx.labelled(spark, sf), "rid", 20, iterations=10, seed=42)
    return cp.serialise_records(draws, ["iter"], ["draw", "rid", "y"], order="draw")


@register("g1_serialise_records", f"SELECT iter, md5(data) AS data_md5, length(data) AS n_chars FROM ({_SER_SQL}) s")
def g1_serialise_records(spark, sf):
    b = _batches(spark, sf)
    return b.select("iter", F.md5("data").alias("data_md5"), F.length("data").alias("n_chars"))


_INSTR = cp.format_instructions(cp.descriptors(["rid", "y"], "y"))


@register("g3_prompts", f"""
SELECT iter, md5(replace(replace('{cp.DEFAULT_TEMPLATE.replace(chr(10), "' || chr(10) || '")}', '{{data}}', data),
                 '{{format_instructions}}', '{_INSTR.replace("'", "''")}')) AS user_md5
FROM ({_SER_SQL}) s""")
def g3_prompts(spark, sf):
    p = cp.build_prompts(_batches(spark, sf), instructions=_INSTR)
    return p.select("iter", F.md5("user").alias("user_md5"))


# ---------------------------------------------------------------- G5-G10
@register("g5_fragments", f"SELECT source, iter, choice, frag_pos, frag FROM ({_FRAGS_SQL}) f")
def g5_fragments(spark, sf):
    return cp.explode_fragments(fx.completions(spark, sf)).select("source", "iter", "choice", "frag_pos", "frag")


@register("g6_completion_validity", f"SELECT source, iter, choice, n_frags, valid FROM ({_VALID_SQL}) v")
def g6_completion_validity(spark, sf):
    c = fx.completions(spark, sf)
    return c.select("source", "iter", "choice", F.size(cp.fragments(F.col("text"))).alias("n_frags"),
                    cp.completion_valid(F.col("text")).alias("valid"))


_COLS7 = TARGETS + ["note"]


@register("g6_parsed_cells", f"""
SELECT source, iter, choice, frag_pos, {', '.join(f"{_text(c)} AS {c}" for c in _COLS7)}
FROM ({_PARSED_SQL}) p""")
def g6_parsed_cells(spark, sf):
    return cp.to_columns(_parsed(spark, sf), _COLS7)


@register("g6_per_fragment_policy", f"""
SELECT source, iter, choice, frag_pos FROM ({_FRAGS_SQL}) f
WHERE CASE WHEN json_valid(frag) THEN json_type(frag) = 'OBJECT' ELSE false END""")
def g6_per_fragment_policy(spark, sf):
    p = cp.parse_completions(fx.completions(spark, sf), policy="per_fragment")
    return p.select("source", "iter", "choice", "frag_pos")


@register("g7_union_by_name", f"""
SELECT source, iter, choice, frag_pos, {_text('o_orderkey')} AS o_orderkey, {_text('note')} AS note,
       NULL::VARCHAR AS o_totalprice FROM ({_PARSED_SQL}) p WHERE source = 'gpt4'
UNION ALL
SELECT source, iter, choice, frag_pos, {_text('o_orderkey')}, NULL, {_text('o_totalprice')}
FROM ({_PARSED_SQL}) p WHERE source = 'llama'""")
def g7_union_by_name(spark, sf):
    p = _parsed(spark, sf)
    a = cp.to_columns(p.where(F.col("source") == "gpt4"), ["o_orderkey", "note"])
    b = cp.to_columns(p.where(F.col("source") == "llama"), ["o_orderkey", "o_totalprice"])
    return cp.union_sources([a, b])


@register("g8_quota_cut", f"""
WITH rows AS (SELECT source, iter FROM ({_PARSED_SQL}) p),
c AS (SELECT source, iter, count(*) AS n FROM rows GROUP BY source, iter),
cc AS (SELECT source, iter, sum(n) OVER (PARTITION BY source ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS prev FROM c)
SELECT source, iter, count(*) AS n_rows FROM rows
WHERE (source, iter) IN (SELECT source, iter FROM cc WHERE prev < 1000)
GROUP BY source, iter""")
def g8_quota_cut(spark, sf):
    kept = cp.quota_cut(_parsed(spark, sf).select("source", "iter"), 1000)
    return kept.groupBy("source", "iter").agg(F.count("*").alias("n_rows"))


@register("g9_reaccumulate", f"""
WITH c AS (SELECT source, iter, count(*) AS n FROM ({_PARSED_SQL}) p GROUP BY source, iter)
SELECT source, CAST(iter AS INTEGER) AS round,
       CAST(sum(n) OVER (PARTITION BY source ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_rows
FROM c""")
def g9_reaccumulate(spark, sf):
    """Rows present at each round when every round re-adds all earlier rounds (counts form)."""
    return cp.reaccumulated_counts(_parsed(spark, sf).select("source", "iter"))


@register("g10_label_split", f"""
SELECT source, iter, choice, frag_pos, {_text('o_orderkey')} AS o_orderkey, {_text('o_orderstatus')} AS target
FROM ({_PARSED_SQL}) p""")
def g10_label_split(spark, sf):
    p = cp.to_columns(_parsed(spark, sf), ["o_orderkey", "o_orderstatus"])
    return cp.split_label(p, {"orders": "o_orderstatus"}, "orders")


# ---------------------------------------------------------------- C1-C8
@register("c1_placeholders_parse", f"""
SELECT source, iter, choice, frag_pos FROM ({_PARSED_SQL}) p WHERE NOT {_placeholder_sql(cl.PLACEHOLDERS_PARSE)}""")
def c1_placeholders_parse(spark, sf):
    return cl.drop_placeholders(_parsed(spark, sf), cl.PLACEHOLDERS_PARSE).select(*KEYS)


@register("c1_placeholders_clean", f"""
SELECT source, iter, choice, frag_pos FROM ({_PARSED_SQL}) p WHERE NOT {_placeholder_sql(cl.PLACEHOLDERS_CLEAN)}""")
def c1_placeholders_clean(spark, sf):
    return cl.drop_placeholders(_parsed(spark, sf), cl.PLACEHOLDERS_CLEAN).select(*KEYS)


_NOTNULL_SQL = " AND ".join(f"coalesce({_kind(c)}, 'NULL') <> 'NULL'" for c in TARGETS)


@register("c2_drop_null_cells", f"SELECT source, iter, choice, frag_pos FROM ({_PARSED_SQL}) p WHERE {_NOTNULL_SQL}")
def c2_drop_null_cells(spark, sf):
    return cl._drop_null_cells(_parsed(spark, sf), TARGETS, "_v").select(*KEYS)


@register("c2_dropna_typed", f"""
SELECT * FROM ({_final(_conform_sql(_PARSED_SQL))}) t
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
  AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def c2_dropna_typed(spark, sf):
    good, _ = cl.conform(_parsed(spark, sf), ORDER_SCHEMA, keep=KEYS)
    return _typed(cl.drop_nulls(good, TARGETS))


@register("c3_sentinel_to_null", """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders""")
def c3_sentinel_to_null(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", cl.sentinel_to_null(F.col("o_orderstatus"), "P").alias("o_orderstatus"))


@register("c4_row_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")
def c4_row_filter(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return cl.keep_where(o, (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "P")).select("o_orderkey")


@register("c5_conform_strict", _final(_conform_sql(_PARSED_SQL)))
def c5_conform_strict(spark, sf):
    good, _ = cl.conform(_parsed(spark, sf), ORDER_SCHEMA, keep=KEYS)
    return _typed(good)


def _reject_sql():
    parts = []
    for c in TARGETS:
        _, ok = _conv_sql(c, _TYPES[c])
        parts.append(f"WHEN NOT {ok} THEN '{c}'")
    return f"CASE {' '.join(parts)} END"


@register("c5_conform_rejects", f"""
SELECT source, iter, choice, frag_pos, {_reject_sql()} AS reject_column
FROM ({_PARSED_SQL}) p WHERE NOT {_LIST_SQL} AND ({_reject_sql()}) IS NOT NULL""")
def c5_conform_rejects(spark, sf):
    _, rej = cl.conform(_parsed(spark, sf), ORDER_SCHEMA, keep=KEYS)
    return rej


@register("c6_conform_coerce", _final(_conform_sql(_PARSED_SQL, "coerce")))
def c6_conform_coerce(spark, sf):
    good, _ = cl.conform(_parsed(spark, sf), ORDER_SCHEMA, int_strings="coerce", keep=KEYS)
    return _typed(good)


@register("c7_drop_list_rows", f"SELECT source, iter, choice, frag_pos FROM ({_PARSED_SQL}) p WHERE NOT {_LIST_SQL}")
def c7_drop_list_rows(spark, sf):
    return cl.drop_list_rows(_parsed(spark, sf)).select(*KEYS)


_NO_PH = f"NOT {_placeholder_sql(cl.PLACEHOLDERS_CLEAN)}"


@register("c8_clean_gpt", _final(_conform_sql(f"SELECT * FROM ({_PARSED_SQL}) p WHERE {_NO_PH} AND {_NOTNULL_SQL}", "coerce")))
def c8_clean_gpt(spark, sf):
    return _typed(cl.clean_generated(_parsed(spark, sf), ORDER_SCHEMA, "gpt"))


@register("c8_clean_llama", _final(_conform_sql(f"SELECT * FROM ({_PARSED_SQL}) p WHERE {_NO_PH}")))
def c8_clean_llama(spark, sf):
    return _typed(cl.clean_generated(_parsed(spark, sf), ORDER_SCHEMA, "llama"))


@register("c8_clean_swahili", _final(_conform_sql(f"SELECT * FROM ({_PARSED_SQL}) p WHERE {_NOTNULL_SQL} AND {_NO_PH}")))
def c8_clean_swahili(spark, sf):
    return _typed(cl.clean_generated(_parsed(spark, sf), ORDER_SCHEMA, "swahili"))


_FILL = {"o_totalprice": "o_custkey", "o_orderpriority": "o_orderstatus"}


def _filled_sql(c):
    """(conversion, its test, whether the cell is a placeholder) of a target cell after the fill."""
    empty = f"coalesce({_kind(c)}, 'NULL') = 'NULL'"
    own, other = ((*_conv_sql(x, _TYPES[c]), f"coalesce({_kind(x)} = 'VARCHAR' AND {_text(x)} IN ({_words(cl.PLACEHOLDERS_CLEAN)}), false)")
                  for x in (c, _FILL.get(c, c)))
    return [f"CASE WHEN {empty} THEN {b} ELSE {a} END" for a, b in zip(own, other, strict=True)]


@register("c8_clean_together", _final(f"""
SELECT source, iter, choice, frag_pos, {', '.join(f"{_filled_sql(c)[0]} AS {c}" for c in TARGETS)} FROM ({_PARSED_SQL}) p
WHERE {' AND '.join(f"({_filled_sql(c)[1]}) AND NOT ({_filled_sql(c)[2]})" for c in TARGETS)}"""))
def c8_clean_together(spark, sf):
    """Missing cells are filled from others, then only the target cells are cleaned."""
    return _typed(cl.clean_generated(_parsed(spark, sf), ORDER_SCHEMA, "together", fill=_FILL))


_STATUS = {"F": 1, "O": 0}
_REPAIRED = StructType([StructField(f.name, LongType() if f.name in ("o_orderstatus", "o_totalprice") else f.dataType) for f in ORDER_SCHEMA.fields])
_PRICE_SQL = _conv_sql("o_totalprice", "double")[0]


@register("c8_clean_llama_repairs", f"""
SELECT * FROM (
  SELECT source, iter, choice, frag_pos, {_conv_sql('o_orderkey', 'bigint')[0]} AS o_orderkey, {_conv_sql('o_custkey', 'bigint')[0]} AS o_custkey,
         CAST(CASE WHEN {_kind('o_orderstatus')} = 'VARCHAR' THEN CASE {_text('o_orderstatus')} WHEN 'F' THEN 1 WHEN 'O' THEN 0 END END AS BIGINT) AS o_orderstatus,
         CAST(CASE WHEN price > 1 AND price < 50000 THEN 0 WHEN price >= 50000 THEN 1 ELSE trunc(price) END AS BIGINT) AS o_totalprice,
         {_conv_sql('o_orderpriority', 'string')[0]} AS o_orderpriority
  FROM (SELECT *, {_PRICE_SQL} AS price FROM ({_PARSED_SQL}) p WHERE {_NO_PH} AND NOT {_LIST_SQL}) q
  WHERE {_conv_sql('o_orderpriority', 'string')[1]}) z
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL""")
def c8_clean_llama_repairs(spark, sf):
    """List rows go, a status is mapped by a dictionary, a price becomes the label on which side of 50,000 it is."""
    return cl.clean_generated(_parsed(spark, sf), _REPAIRED, "llama", keep=KEYS, repairs={"o_orderstatus": _STATUS, "o_totalprice": "label"})
