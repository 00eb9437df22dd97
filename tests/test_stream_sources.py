from pyspark.sql import functions as F

from rowsift.operators import clean as cl
from rowsift.operators import completions as cp
from rowsift.session import scratch_path
from rowsift.sources import fixtures as fx
from rowsift.sources import registry as reg
from rowsift.streaming import completions_stream as cs
from tests.conftest import SF_TINY


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "landing")
    fx.completions(spark, SF_TINY).repartition(4).write.parquet(src)
    sink = scratch_path(spark, "sink")
    cs.run_curation_stream(spark, src, sink, scratch_path(spark, "ckpt"), fx.ORDER_STRUCT, "gpt")
    streamed = spark.read.parquet(sink)
    batch = cl.clean_generated(cp.parse_completions(fx.completions(spark, SF_TINY)), fx.ORDER_STRUCT, "gpt")
    cols = sorted(batch.columns)
    assert streamed.count() == batch.count() > 0
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0


def test_scored_stream_equals_batch(spark):
    """A saved model inside the stream, one file per trigger."""
    from pyspark.ml import PipelineModel

    from rowsift.operators import staging
    orders = spark.read.parquet(f"{SF_TINY}/orders.parquet").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    path = scratch_path(spark, "saved")
    staging.fit_gbt(orders, ["o_totalprice", "o_custkey"], "y", nest=5, max_depth=3).write().save(path)
    score = cs.score_with(PipelineModel.load(path), "y", 0.45, 0.25)
    label = lambda rows: score(rows.withColumn("y", (F.col("o_orderstatus") == "F").cast("int")))
    src, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "sink", "ckpt"))
    fx.completions(spark, SF_TINY).repartition(4).write.parquet(src)
    cs.run_curation_stream(spark, src, sink, ckpt, fx.ORDER_STRUCT, "gpt", label, max_files_per_trigger=1)
    batch = label(cl.clean_generated(cp.parse_completions(fx.completions(spark, SF_TINY)), fx.ORDER_STRUCT, "gpt"))
    streamed = spark.read.parquet(sink).select(batch.columns)
    assert streamed.count() == batch.count() > 0 and streamed.select("grp").distinct().count() > 1
    assert streamed.exceptAll(batch).count() == 0
    assert len(spark.read.text(f"{ckpt}/commits/[0-9]*").inputFiles()) == 4


def test_quota_survives_a_restart(spark):
    rows = [("a", i, 0, f'{{"k": {i}}}') for i in range(10)] + [("b", i, 0, f'{{"k": {i}}}') for i in range(3)]
    schema = "source string, iter int, choice int, text string"
    src, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "ckpt")
    target = fx.StructType([fx.StructField("k", fx.LongType())])
    run = lambda: {r["source"]: (r["n_accepted"], r["quota_reached"]) for r in
                   cs.run_quota_counter(spark, src, ckpt, target, 6, "q", max_files_per_trigger=1).collect()}
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(src)
    assert run() == {"a": (4, False)}
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == {"a": (6, True), "b": (3, False)} == run()
    sink = cs.QuotaSink(f"{ckpt}/_q", 6)
    kept = sorted((r["source"], r["k"]) for r in sink.accepted(spark).collect())
    assert kept == [("a", k) for k in range(6)] + [("b", k) for k in range(3)]
    batch = cl.clean_generated(cp.parse_completions(spark.createDataFrame(rows[4:], schema)), target, "gpt")
    sink(batch, 1)  # the last epoch again, as after a stop before its commit
    assert sorted((r["source"], r["k"]) for r in sink.accepted(spark).collect()) == kept and run() == {"a": (6, True), "b": (3, False)}


def test_bundles_prune_partitions(spark):
    path = scratch_path(spark, "bundles")
    reg.save_bundle(fx.results(spark, SF_TINY), path)
    back = reg.load_bundles(spark, path, dataset=["click"], ns=20)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dataset" in plan
    assert back.where(F.col("dataset") != "click").count() == 0
    assert back.count() == fx.results(spark, SF_TINY).where("dataset = 'click' AND ns = 20").count()
