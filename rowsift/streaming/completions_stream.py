"""Structured Streaming re-aims (ST1, ST2).

ST1: completion files arrive in a folder -> the *same* batch functions
(fragment extraction, strict JSON validity via per-row ``forall``,
placeholder filter, schema conformance, and with a ``score`` function the staged
dynamics and groups of K3 and K17 under fixed thresholds) -> appended to a curated
parquet sink. Everything is stateless per completion row, so the stream equals the
batch however the files are dealt to micro-batches.

ST2: rows are accepted up to a quota per source. The state of an epoch (accepted rows
per source so far) and its accepted rows are written under the epoch's number and
depend only on earlier epochs and the batch, so an epoch that is run again after a
stop writes the same: exactly once. A batch ships at most the quota per source and
map task to the ranking; no task holds the rows of a source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from rowsift.operators import clean as cl
from rowsift.operators import completions as cp
from rowsift.operators import dynamics as dyn
from rowsift.operators import staging
from rowsift.operators.attach import attach
from rowsift.session import remove_path, scratch_path

COMPLETION_SCHEMA = "source string, iter int, choice int, text string"


def read_completions(spark: SparkSession, folder: str, schema: str = COMPLETION_SCHEMA,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def curated_rows(stream: DataFrame, target: StructType, preset: str = "gpt") -> DataFrame:
    """Per-row cleaning of a completions stream (identical code path to batch)."""
    return cl.clean_generated(cp.parse_completions(stream), target, preset)


Score = Callable[[DataFrame], DataFrame]


def score_with(model, label: str, ythresh: float = 0.2, xthresh: float = 0.2, metric: str = "aleatoric") -> Score:
    """Rows -> rows with the staged dynamics of a fitted (loaded) ensemble and their group (K3 + K17, fixed thresholds)."""
    if xthresh == 0:
        raise ValueError("an adaptive threshold needs the whole table; a stream takes a fixed one")
    return lambda rows: dyn.assign_groups(staging.staged_dynamics(model, rows, label), metric, ythresh, xthresh)


def run_curation_stream(spark: SparkSession, source_folder: str, sink_folder: str, checkpoint: str,
                        target: StructType, preset: str = "gpt", score: Score | None = None, max_files_per_trigger: int | None = None) -> None:
    """Process everything available now into the parquet sink, then stop (exactly-once via checkpoint)."""
    rows = curated_rows(read_completions(spark, source_folder, max_files_per_trigger=max_files_per_trigger), target, preset)
    q = ((score(rows) if score else rows)
         .writeStream.format("parquet").option("path", sink_folder)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


class QuotaSink:
    """``foreachBatch`` sink that accepts at most ``quota`` rows per source, in the order of ``order`` inside a batch."""

    def __init__(self, folder: str, quota: int, order: Sequence[str] = ("iter", "choice", "frag_pos")):
        self.folder, self.quota, self.order = folder.rstrip("/"), quota, tuple(order)

    def state(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """source, n_accepted after the last epoch (before epoch ``before``)."""
        schema = "source string, n_accepted bigint, epoch bigint"
        try:
            told = spark.read.schema(schema).parquet(f"{self.folder}/state")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            told = spark.createDataFrame([], schema)  # no epoch yet
        if before is not None:
            told = told.where(F.col("epoch") < before)
        return told.groupBy("source").agg(F.max("n_accepted").alias("n_accepted"))  # one row per source and epoch

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        written = scratch_path(batch.sparkSession, "quota-batch")
        batch.write.parquet(written)  # its plan runs once
        batch = batch.sparkSession.read.parquet(written)
        left = attach(batch, self.state(batch.sparkSession, epoch), ["source"]).withColumn("_left", self.quota - F.coalesce("n_accepted", F.lit(0)))
        ranked = left.where("_left > 0").withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy(*self.order)))
        taken = ranked.where((F.col("_rank") <= self.quota) & (F.col("_rank") <= F.col("_left"))).drop("_left", "_rank", "n_accepted")
        taken.write.mode("overwrite").parquet(f"{self.folder}/rows/epoch={epoch}")
        new = batch.sparkSession.read.schema(taken.schema).parquet(f"{self.folder}/rows/epoch={epoch}").groupBy("source").agg(F.count("*").alias("new"))
        every = batch.select("source").distinct()
        done = attach(attach(every, new, ["source"]), self.state(batch.sparkSession, epoch), ["source"])
        done.select("source", (F.coalesce("n_accepted", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("n_accepted")) \
            .write.mode("overwrite").parquet(f"{self.folder}/state/epoch={epoch}")
        remove_path(batch.sparkSession, written)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows").drop("epoch")


def run_quota_counter(spark: SparkSession, source_folder: str, checkpoint: str, target: StructType,
                      quota: int, table_name: str, preset: str = "gpt", max_files_per_trigger: int | None = None) -> DataFrame:
    """Accepted rows per source (``n_accepted``, cut at the quota) and whether the quota is reached. May be called again
    with the same checkpoint when more files have arrived; the accepted rows lie in ``_<table_name>/rows``."""
    sink = QuotaSink(f"{checkpoint.rstrip('/')}/_{table_name}", quota)
    rows = curated_rows(read_completions(spark, source_folder, max_files_per_trigger=max_files_per_trigger), target, preset)
    q = (rows.writeStream.outputMode("append").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink.state(spark).withColumn("quota_reached", F.col("n_accepted") >= F.lit(quota))
