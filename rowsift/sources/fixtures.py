"""Fixture tables derived from the driver's parquet tables (FIXTURES.md part B).

Every fixture has a Spark builder and the equivalent DuckDB SQL text so the
oracle checks the same input. All randomness is ``md5(key|seed)``.
Nothing here is synthesised from scratch: every row comes from a given table,
so the work of every downstream query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from rowsift.functions.hashing import h
from rowsift.session import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---------------------------------------------------------------- F1
_RID = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def rid_col() -> F.Column:
    return F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a clean label, ~10 % hash flips and the noisy label y."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(rid_col().alias("rid"), *FEATURES)
    clean = ((F.col("l_extendedprice") * (1 - F.col("l_discount"))) > 30000).cast("int")
    flip = (F.substring(h("rid", "f"), 1, 2) < "1a").cast("int")
    return (df.withColumn("clean", clean).withColumn("flip", flip)
              .withColumn("y", ((F.col("clean") + F.col("flip")) % 2).cast("int")))


F1_SQL = f"""
SELECT rid, l_quantity, l_extendedprice, l_discount, l_tax, clean, flip,
       CAST((clean + flip) % 2 AS INTEGER) AS y
FROM (SELECT {_RID} AS rid, l_quantity, l_extendedprice, l_discount, l_tax,
             CAST(l_extendedprice * (1 - l_discount) > 30000 AS INTEGER) AS clean,
             CAST(substring(md5(concat({_RID}, '|', 'f')), 1, 2) < '1a' AS INTEGER) AS flip
      FROM lineitem) f1
"""

# ---------------------------------------------------------------- F2
N_CHECKPOINTS = 9


def _p_expr(y, q, d, t, c):
    raw = (F.lit(0.5) + (2 * y - 1) * ((q - F.lit(25.5)) / F.lit(30.0) + (c - 5) * F.lit(0.02))
           + (d - F.lit(0.05)) * F.lit(2.0) + (t - F.lit(0.04)) * F.lit(1.5))
    # dyadic probabilities (k/1024) keep sums exact in every engine
    return F.greatest(F.least(F.floor(raw * 1024), F.lit(1014)), F.lit(10)) / F.lit(1024.0)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 long: (source, rid, y, checkpoint, p)."""
    f1 = labelled(spark, sf_dir)
    src = F.when(F.substring(h("rid", "s"), 1, 1) < "8", "syn_a").otherwise("syn_b")
    long = (f1.select(src.alias("source"), "rid", "y", *FEATURES)
              .withColumn("checkpoint", F.explode(F.sequence(F.lit(1), F.lit(N_CHECKPOINTS)))))
    p = _p_expr(F.col("y"), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("checkpoint"))
    return long.select("source", "rid", "y", F.col("checkpoint").cast("int"), p.alias("p"))


def probabilities_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 wide: (source, rid, y, p ARRAY<DOUBLE>) without any shuffle."""
    f1 = labelled(spark, sf_dir)
    src = F.when(F.substring(h("rid", "s"), 1, 1) < "8", "syn_a").otherwise("syn_b")
    arr = F.transform(F.sequence(F.lit(1), F.lit(N_CHECKPOINTS)),
                      lambda c: _p_expr(F.col("y"), F.col("l_quantity"), F.col("l_discount"),
                                        F.col("l_tax"), c))
    return f1.select(src.alias("source"), "rid", "y", arr.alias("p"))


F2_SQL = f"""
SELECT source, rid, y, checkpoint,
       greatest(least(floor((0.5 + (2 * y - 1) * ((l_quantity - 25.5) / 30.0 + (checkpoint - 5) * 0.02)
                             + (l_discount - 0.05) * 2.0 + (l_tax - 0.04) * 1.5) * 1024), 1014), 10) / 1024.0 AS p
FROM (SELECT CASE WHEN substring(md5(concat(rid, '|', 's')), 1, 1) < '8' THEN 'syn_a' ELSE 'syn_b' END AS source,
             rid, y, l_quantity, l_discount, l_tax, CAST(c.checkpoint AS INTEGER) AS checkpoint
      FROM ({F1_SQL}) f1 CROSS JOIN range(1, {N_CHECKPOINTS + 1}) c(checkpoint)) f2
"""

# ---------------------------------------------------------------- F3
# The fragment variants cycle by o_orderkey % 20.
ORDER_SCHEMA = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
ORDER_STRUCT = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                           StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
                           StructField("o_orderpriority", StringType())])
SOURCES_F3 = ["gpt4", "llama", "together"]


def _frag_spark() -> F.Column:
    k = F.col("o_orderkey").cast("string")
    c = F.col("o_custkey").cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    price = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                     F.lpad((cents % 100).cast("string"), 2, "0"))
    st = F.col("o_orderstatus")
    pr = F.col("o_orderpriority")

    def obj(kv, custkey=None, status=None, total=None, prio=None, extra=None):
        parts = [F.lit('{"o_orderkey": '), k]
        parts += [F.lit(', "o_custkey": '), custkey if custkey is not None else c]
        parts += [F.lit(', "o_orderstatus": '), status if status is not None else F.concat(F.lit('"'), st, F.lit('"'))]
        parts += [F.lit(', "o_totalprice": '), total if total is not None else price]
        if prio is not False:
            parts += [F.lit(', "o_orderpriority": "'), pr, F.lit('"')]
        if extra is not None:
            parts += [F.lit(extra)]
        parts += [F.lit("}")]
        return F.concat(*parts)

    m = F.col("o_orderkey") % 20
    return (F.when(m == 0, obj(None, status=F.lit('"integer"')))
             .when(m == 1, obj(None, prio=False))
             .when(m == 2, obj(None, extra=', "note": "extra"'))
             .when(m == 3, F.concat(F.lit('{"o_orderkey": '), k, F.lit(', "o_custkey": }')))
             .when(m == 4, obj(None, total=F.lit("[1, 2]")))
             .when(m == 5, obj(None, total=F.concat(F.lit('"'), price, F.lit('"'))))
             .when(m == 6, obj(None, custkey=F.concat(F.lit('"'), c, F.lit('"'))))
             .when(m == 7, obj(None, custkey=F.concat(c, F.lit(".5"))))
             .when(m == 8, F.concat(F.lit("{'o_orderkey': "), k, F.lit("}")))
             .when(m == 9, obj(None, status=F.lit('"Yes"')))
             .when(m == 10, obj(None, total=F.lit("null")))
             .when(m == 11, obj(None, custkey=F.lit('""')))
             .when(m == 12, obj(None, custkey=F.lit('"abc"')))
             .when(m == 13, obj(None, custkey=F.lit('"1e3"')))
             .when(m == 14, obj(None, custkey=F.lit("true")))
             .otherwise(obj(None)))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, iter, choice, text). Three order fragments per completion."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    frags = o.select(F.floor(F.col("o_orderkey") / 3).alias("comp"), "o_orderkey",
                     _frag_spark().alias("frag"))
    per = frags.groupBy("comp").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "frag"))),
                                      lambda x: x["frag"])).alias("body"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prose"))
    n_docs = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"))  # one row
    per = per.crossJoin(F.broadcast(n_docs)).withColumn("doc_id", F.col("comp") % F.col("n_docs")).drop("n_docs")
    joined = per.join(docs, "doc_id", "left")
    src = F.element_at(F.array(*[F.lit(s) for s in SOURCES_F3]), (F.col("comp") % 3 + 1).cast("int"))
    return joined.select(
        src.alias("source"),
        F.floor(F.col("comp") / 6).cast("int").alias("iter"),
        (F.floor(F.col("comp") / 3) % 2).cast("int").alias("choice"),
        F.concat(F.coalesce(F.col("prose"), F.lit("")), F.lit("\nHere are the rows:\n"), F.col("body")).alias("text"))


_K = "CAST(o_orderkey AS VARCHAR)"
_C = "CAST(o_custkey AS VARCHAR)"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_PRICE = f"concat(CAST({_CENTS} // 100 AS VARCHAR), '.', lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0'))"


def _obj_sql(custkey=None, status=None, total=None, prio=True, extra=None):
    parts = ["'{\"o_orderkey\": '", _K, "', \"o_custkey\": '", custkey or _C,
             "', \"o_orderstatus\": '", status or "concat('\"', o_orderstatus, '\"')",
             "', \"o_totalprice\": '", total or _PRICE]
    if prio:
        parts += ["', \"o_orderpriority\": \"'", "o_orderpriority", "'\"'"]
    if extra:
        parts += [f"'{extra}'"]
    parts += ["'}'"]
    return "concat(" + ", ".join(parts) + ")"


F3_FRAG_SQL = f"""CASE o_orderkey % 20
  WHEN 0 THEN {_obj_sql(status="'\"integer\"'")}
  WHEN 1 THEN {_obj_sql(prio=False)}
  WHEN 2 THEN {_obj_sql(extra=', "note": "extra"')}
  WHEN 3 THEN concat('{{"o_orderkey": ', {_K}, ', "o_custkey": }}')
  WHEN 4 THEN {_obj_sql(total="'[1, 2]'")}
  WHEN 5 THEN {_obj_sql(total=f"concat('\"', {_PRICE}, '\"')")}
  WHEN 6 THEN {_obj_sql(custkey=f"concat('\"', {_C}, '\"')")}
  WHEN 7 THEN {_obj_sql(custkey=f"concat({_C}, '.5')")}
  WHEN 8 THEN concat('{{''o_orderkey'': ', {_K}, '}}')
  WHEN 9 THEN {_obj_sql(status="'\"Yes\"'")}
  WHEN 10 THEN {_obj_sql(total="'null'")}
  WHEN 11 THEN {_obj_sql(custkey="'\"\"'")}
  WHEN 12 THEN {_obj_sql(custkey="'\"abc\"'")}
  WHEN 13 THEN {_obj_sql(custkey="'\"1e3\"'")}
  WHEN 14 THEN {_obj_sql(custkey="'true'")}
  ELSE {_obj_sql()} END"""

F3_SQL = f"""
SELECT (['gpt4', 'llama', 'together'])[CAST(comp % 3 + 1 AS INTEGER)] AS source,
       CAST(floor(comp / 6) AS INTEGER) AS iter,
       CAST(floor(comp / 3) % 2 AS INTEGER) AS choice,
       concat(coalesce(d.text, ''), chr(10) || 'Here are the rows:' || chr(10), body) AS text
FROM (SELECT comp, string_agg(frag, chr(10) ORDER BY o_orderkey) AS body
      FROM (SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS comp, o_orderkey, {F3_FRAG_SQL} AS frag FROM orders) fr
      GROUP BY comp) g
LEFT JOIN documents d ON d.doc_id = g.comp % (SELECT greatest(count(*), 1) FROM documents)
"""

# ---------------------------------------------------------------- F4
def real_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem features split into real / syn_a / syn_b (syn_b shifted)."""
    f1 = labelled(spark, sf_dir)
    b = F.substring(h("rid", "q"), 1, 1)
    src = F.when(b < "6", "real").when(b < "b", "syn_a").otherwise("syn_b")
    scaled = F.col("source") == "syn_b"
    return (f1.select("rid", src.alias("source"), *FEATURES, "y")
              .select("rid", "source",
                      F.when(scaled, F.col("l_quantity") * 1.25).otherwise(F.col("l_quantity")).alias("l_quantity"),
                      F.when(scaled, F.col("l_extendedprice") * 0.8).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
                      "l_discount",
                      F.when(scaled, F.col("l_tax") + 0.02).otherwise(F.col("l_tax")).alias("l_tax"),
                      "y"))


F4_SQL = f"""
SELECT rid, source,
       CASE WHEN source = 'syn_b' THEN l_quantity * 1.25 ELSE l_quantity END AS l_quantity,
       CASE WHEN source = 'syn_b' THEN l_extendedprice * 0.8 ELSE l_extendedprice END AS l_extendedprice,
       l_discount,
       CASE WHEN source = 'syn_b' THEN l_tax + 0.02 ELSE l_tax END AS l_tax,
       y
FROM (SELECT rid, l_quantity, l_extendedprice, l_discount, l_tax, y,
             CASE WHEN substring(md5(concat(rid, '|', 'q')), 1, 1) < '6' THEN 'real'
                  WHEN substring(md5(concat(rid, '|', 'q')), 1, 1) < 'b' THEN 'syn_a' ELSE 'syn_b' END AS source
      FROM ({F1_SQL}) f1) f4
"""

# ---------------------------------------------------------------- F5
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as ARRAY<DOUBLE> with the class label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


F5_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"

# ---------------------------------------------------------------- F7
CLASSIFIERS = ["gbt", "rf", "lr", "dt"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per (source, clf, rid) a label, a tied score and its hard prediction."""
    f1 = labelled(spark, sf_dir)
    src = F.when(F.substring(h("rid", "e"), 1, 1) < "8", "real").otherwise("syn_a")
    df = f1.select(src.alias("source"), "rid", "y", "l_quantity", "l_extendedprice", "l_discount")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    raw = (F.lit(0.5) + (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000) / 60000.0
           + F.col("k") * (F.col("l_quantity") - 25) / 200.0)
    score = F.greatest(F.least(F.floor(raw * 50), F.lit(50)), F.lit(0)) / F.lit(50.0)
    clf = F.element_at(F.array(*[F.lit(c) for c in CLASSIFIERS]), (F.col("k") + 1).cast("int"))
    return df.select("source", clf.alias("clf"), "rid", "y",
                     (score >= 0.5).cast("int").alias("y_pred"), score.alias("score"))


F7_SQL = f"""
SELECT source, (['gbt', 'rf', 'lr', 'dt'])[CAST(k + 1 AS INTEGER)] AS clf, rid, y,
       CAST(score >= 0.5 AS INTEGER) AS y_pred, score
FROM (SELECT source, rid, y, k,
             greatest(least(floor((0.5 + (l_extendedprice * (1 - l_discount) - 30000) / 60000.0
                                   + k * (l_quantity - 25) / 200.0) * 50), 50), 0) / 50.0 AS score
      FROM (SELECT CASE WHEN substring(md5(concat(rid, '|', 'e')), 1, 1) < '8' THEN 'real' ELSE 'syn_a' END AS source,
                   rid, y, l_quantity, l_extendedprice, l_discount
            FROM ({F1_SQL}) f1) a CROSS JOIN range(0, 4) t(k)) f7
"""

# ---------------------------------------------------------------- F8 / F9
# Grid axes used to key the events table as experiment results.
NS_VALUES = [10, 20, 50, 100]
SOURCE_VALUES = ["Original", "gpt4", "gpt4_curated", "tvae"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: (dataset, ns, seed, source, metric, score) as means over events."""
    ev = table(spark, sf_dir, "events")
    ns = F.element_at(F.array(*[F.lit(v) for v in NS_VALUES]), (F.col("user_id") % 4 + 1).cast("int"))
    src = F.element_at(F.array(*[F.lit(v) for v in SOURCE_VALUES]), (F.col("event_id") % 4 + 1).cast("int"))
    metric = F.when(F.col("event_id") % 8 < 4, "accuracy").otherwise("auc")
    return (ev.select(F.col("event_type").alias("dataset"), ns.cast("int").alias("ns"),
                      (F.floor(F.col("user_id") / 4) % 5).cast("int").alias("seed"),
                      src.alias("source"), metric.alias("metric"), "value")
              .groupBy("dataset", "ns", "seed", "source", "metric")
              .agg((F.avg("value") / 97.0).alias("score")))


F8_SQL = """
SELECT dataset, ns, seed, source, metric, avg(value) / 97.0 AS score
FROM (SELECT event_type AS dataset, CAST(([10, 20, 50, 100])[CAST(user_id % 4 + 1 AS INTEGER)] AS INTEGER) AS ns,
             CAST(floor(user_id / 4) % 5 AS INTEGER) AS seed,
             (['Original', 'gpt4', 'gpt4_curated', 'tvae'])[CAST(event_id % 4 + 1 AS INTEGER)] AS source,
             CASE WHEN event_id % 8 < 4 THEN 'accuracy' ELSE 'auc' END AS metric, value
      FROM events) e
GROUP BY dataset, ns, seed, source, metric
"""


def subgroup_gains(spark: SparkSession, sf_dir: str, generator: int | None = None) -> DataFrame:
    """(seed, subgroup, n_orig, n_gen, gain), of all events or of one of two generators (0, 1)."""
    ev = table(spark, sf_dir, "events")
    if generator is not None:
        ev = ev.where(F.floor(F.col("event_id") / 5) % 2 == generator)
    return (ev.select((F.col("event_id") % 5).cast("int").alias("seed"),
                      F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("subgroup"),
                      "value")
              .groupBy("seed", "subgroup")
              .agg(F.count("*").cast("int").alias("n_orig"),
                   F.sum((F.col("value") > 50).cast("int")).cast("int").alias("n_gen"),
                   ((F.avg("value") - 50) / 100.0).alias("gain")))


F9_SQL = """
SELECT seed, subgroup, CAST(count(*) AS INTEGER) AS n_orig,
       CAST(sum(CAST(value > 50 AS INTEGER)) AS INTEGER) AS n_gen, (avg(value) - 50) / 100.0 AS gain
FROM (SELECT CAST(event_id % 5 AS INTEGER) AS seed,
             concat(event_type, '_', CAST(user_id % 10 AS VARCHAR)) AS subgroup, value FROM events) e
GROUP BY seed, subgroup
"""


def f9_sql(generator: int) -> str:
    return F9_SQL.replace("FROM events)", f"FROM events WHERE (event_id // 5) % 2 = {generator})")


# ---------------------------------------------------------------- F10
def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "inner")


F10_SQL = """
SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
