"""Checked queries for the streaming re-aims (ST1, ST2): the stream must equal the batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rowsift.operators import dynamics as dyn
from rowsift.operators import staging
from rowsift.plans.catalog import r6, register
from rowsift.plans.q_completions import ORDER_SCHEMA, _conform_sql, _final, _NO_PH, _NOTNULL_SQL, _PARSED_SQL
from rowsift.session import remove_path, scratch_path, shuffles_dropped
from rowsift.sources import fixtures as fx
from rowsift.streaming import completions_stream as cs

_GPT_SQL = _final(_conform_sql(f"SELECT * FROM ({_PARSED_SQL}) p WHERE {_NO_PH} AND {_NOTNULL_SQL}", "coerce"))


ARRIVALS = 8
FILE_BYTES = 64 << 20  # text of a landed file
ORDER_BYTES = 130  # text of an order in it


def _text_bytes(spark, sf) -> tuple[float, float]:
    """(text of the completions, text of the documents), in bytes."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.avg(F.octet_length("text")), F.sum(F.octet_length("text"))).first()
    orders = spark.read.parquet(f"{sf}/orders.parquet").agg(F.count_distinct(F.floor(F.col("o_orderkey") / 3)), F.count("*")).first()
    return orders[0] * (texts[0] or 0) + orders[1] * ORDER_BYTES, texts[1] or 0


def _files(text: float) -> int:
    return max(1, math.ceil(text / (ARRIVALS * FILE_BYTES)))


def _land(rows, folder: str, files: int) -> None:
    with shuffles_dropped(rows.sparkSession):
        rows.repartition(files, "source", "iter", "choice").write.parquet(folder)


def _landing(spark, sf) -> tuple[str, int]:
    """Completions land as parquet files in a fresh folder: (folder, files of one of the eight arrivals). An arrival has as
    many files as it takes to keep each of them bounded, whatever the size of the tables."""
    folder = scratch_path(spark, "completions-landing")
    files = _files(_text_bytes(spark, sf)[0])
    _land(fx.completions(spark, sf), folder, ARRIVALS * files)
    return folder, files


def _streamed(spark, sf, run):
    """``run(folder, files of an arrival)`` over all completions, a call for each round of landed files; gives the last call's result.

    A document's text lies in every completion that quotes it, so all of them together may take many times the disk of the
    tables. A round holds at most half as much text as the documents (or eight files of bounded size, if that is more) and goes
    when its run has ended; the stream's checkpoint keeps that it was read."""
    text, documents = _text_bytes(spark, sf)
    files, rounds = _files(text), math.ceil(text / max(ARRIVALS * FILE_BYTES, documents / 2)) or 1
    folder, out = scratch_path(spark, "completions-landing"), None
    for k in range(rounds):
        rows = fx.completions(spark, sf)
        if rounds > 1:
            rows = rows.where(F.pmod(F.xxhash64("source", "iter", "choice"), F.lit(rounds)) == k)
        _land(rows, folder, math.ceil(ARRIVALS * files / rounds))
        out = run(folder, files)
        remove_path(spark, folder)
    return out


@register("st1_stream_curation", _GPT_SQL)
def st1_stream_curation(spark, sf):
    sink, ckpt = scratch_path(spark, "curated-sink"), scratch_path(spark, "st1-ckpt")
    _streamed(spark, sf, lambda src, _: cs.run_curation_stream(spark, src, sink, ckpt, ORDER_SCHEMA, "gpt"))
    out = spark.read.schema(cs.curated_rows(fx.completions(spark, sf), ORDER_SCHEMA).schema).parquet(sink)
    return out.select("source", "iter", "choice", "frag_pos", "o_orderkey", "o_custkey", "o_orderstatus",
                      r6("o_totalprice"), "o_orderpriority")


# Trees of a fixed shape over the order columns; the leaf values are the label means of the orders table.
_STUMPS = [f"o_totalprice > {20000 + 23000 * t} AND o_custkey % {t + 2} = 0" for t in range(12)]
_IS_DONE = "CAST(o_orderstatus = 'F' AS INTEGER)"
_STUMP_LIST = ", ".join(f"CAST({c} AS INTEGER)" for c in _STUMPS)


@register("st1_stream_scored", f"""
WITH t AS (SELECT {_IS_DONE} AS y, [{_STUMP_LIST}] AS leaf FROM orders),
v AS (SELECT tree, leaf, 0.4 * avg(2 * y - 1) AS v FROM (SELECT y, unnest(leaf) AS leaf, unnest(range({len(_STUMPS)})) AS tree FROM t) GROUP BY tree, leaf),
g AS (SELECT row_number() OVER () AS r, source, iter, choice, frag_pos, o_orderkey, {_IS_DONE} AS y, [{_STUMP_LIST}] AS leaf FROM ({_GPT_SQL}) g),
x AS (SELECT r, y, unnest(leaf) AS leaf, unnest(range({len(_STUMPS)})) AS tree FROM g),
f AS (SELECT r, x.tree, 1 / (1 + exp(-2 * (2 * y - 1) * sum(coalesce(v, 0)) OVER (PARTITION BY r ORDER BY x.tree))) AS p
      FROM x LEFT JOIN v ON v.tree = x.tree AND v.leaf = x.leaf),
d AS (SELECT r, avg(p) AS c, avg(p * (1 - p)) AS u FROM f WHERE tree < {len(_STUMPS) - 1} GROUP BY r)
SELECT source, iter, choice, frag_pos, o_orderkey, round(c, 6) AS confidence, round(u, 6) AS aleatoric,
       CASE WHEN c <= 0.45 AND u <= 0.25 THEN 'hard' WHEN c >= 0.55 AND u <= 0.25 THEN 'easy' ELSE 'ambig' END AS grp FROM g JOIN d USING (r)""")
def st1_stream_scored(spark, sf):
    """Parse, clean, score (K3) and group (K17) a completions stream, one arrival per trigger."""
    given = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(_IS_DONE).alias("y"), F.posexplode(F.expr(f"array({_STUMP_LIST})")).alias("tree", "leaf"))
    means = given.groupBy("tree", "leaf").agg(F.array(0.4 * F.avg(2 * F.col("y") - 1)).alias("value"))
    every = spark.range(2 * len(_STUMPS)).select((F.col("id") / 2).cast("int").alias("tree"), (F.col("id") % 2).cast("int").alias("leaf"))
    values = every.join(means, ["tree", "leaf"], "left").select(F.col("tree").alias("step"), "tree", "leaf", F.coalesce("value", F.array(F.lit(0.0))).alias("value"))

    def score(rows):
        with_leaves = rows.withColumn("y", F.expr(_IS_DONE)).withColumn("leaf", F.expr(f"array({_STUMP_LIST})"))
        return dyn.assign_groups(staging.fold_leaves(with_leaves, values, "logit", "leaf"), "aleatoric", 0.45, 0.25)

    sink, ckpt = scratch_path(spark, "scored-sink"), scratch_path(spark, "st1s-ckpt")
    _streamed(spark, sf, lambda src, files: cs.run_curation_stream(spark, src, sink, ckpt, ORDER_SCHEMA, "gpt", score, max_files_per_trigger=files))
    out = spark.read.parquet(sink)
    return out.select("source", "iter", "choice", "frag_pos", "o_orderkey", r6("confidence"), r6("aleatoric"), "grp")


@register("st2_stream_quota", f"""
SELECT source, least(count(*), 2000) AS n_accepted, count(*) >= 2000 AS quota_reached FROM ({_GPT_SQL}) g GROUP BY source""")
def st2_stream_quota(spark, sf):
    ckpt = scratch_path(spark, "st2-ckpt")
    out = _streamed(spark, sf, lambda src, files: cs.run_quota_counter(spark, src, ckpt, ORDER_SCHEMA, 2000, "quota", max_files_per_trigger=files))
    return out.select("source", "n_accepted", F.col("quota_reached"))
