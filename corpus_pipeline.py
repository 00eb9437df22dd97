"""Corpus pipeline: language ID, line dedup, near duplicates, secret scans, packing.

Each stage takes the documents that its predecessor kept and returns documents (the last one:
where each of them lies in the packed bins). ``run`` writes every stage's result as Parquet in
the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsift.llm import language_id, line_mph, packing, parity_join, secret_ledger
from rowsift.llm.common import held, table
from rowsift.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts that don't stand out of the noise of unrelated texts though
    they have as many trigrams as the training texts need for it. Shorter texts stay."""
    training = docs.where(held(docs, "doc_id", 3) != 1)
    prototypes = language_id.train(training)
    least = language_id.decidable(training, prototypes)
    found = language_id.annotate(docs, prototypes)
    kept = (F.col("_lid_lang") != language_id.UNKNOWN) & ((F.col("_lid_cosine") > language_id.noise()) | (F.col("_lid_grams") < least))
    return found.where(kept).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines held by a document with a smaller id, and documents that this leaves blank. A text
    that was blank before goes, too."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = line_mph.dedup(docs, carry=carry)
    kept = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"),
            "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType), **{c: F.col("carry").getField(c) for c in carry}}
    return done.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[kept[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the one with the smallest id (null comes last), of rows with that
    id any one. If ids are null or repeated, rows are told apart by their number in a written table."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        found = parity_join.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_lose"))
        return docs.join(found, docs["doc_id"] == found["_lose"], "left_anti")
    row = max(docs.columns, key=len) + "_row"  # no other column's name
    at = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = parity_join.near_duplicates(at.select(row, "text"), id_col=row).select(F.col("doc_id").alias("_row"), "component_id")
    members = found.join(at.select(row, F.col("doc_id").alias("_id")), F.col("_row") == at[row])
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first"))
    return at.join(first.select(F.col("first._row").alias(row)), row, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every stretch of a text that holds a secret."""
    found = secret_ledger.findings(docs).where(F.size("found") > 0).select("blob", "found").dropDuplicates(["blob"])
    found = cut_lineage(found.select(F.col("blob").alias("_blob"), F.col("found").alias("_found")), "secrets")
    text = F.coalesce(docs["text"], F.lit(""))
    at = docs.withColumn("_key", F.sha2(text, 256))
    at = at.join(found, at["_key"] == found["_blob"], "left")
    masked = F.when(F.col("_found").isNotNull(), secret_ledger.masked(F.col("text"), F.col("_found"))).otherwise(F.col("text"))
    at = at.withColumn("text", masked)
    return at.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, bin_id, bin_offset, size."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("secret scans", secrets), ("best-fit packing", pack)]

#: Hyperdimensional profiles can't be expressed in SQL; the tests hold ``run`` against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
