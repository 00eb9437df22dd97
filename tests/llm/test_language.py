"""The language stage on texts in unlearned languages and on very short clean ones."""
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rowsift.llm import language_id
from rowsift.llm.common import table
from tests.conftest import SF_SMALL

LETTERS = {"greek": range(0x3B1, 0x3CA), "cyrillic": range(0x430, 0x450), "georgian": range(0x10D0, 0x10F1), "han": range(0x4E00, 0x5200)}
SHORT = ["Avec.", "A.", "Der", "the", "Los", "È ééaux éenê épaè."]


def unlearned(n: int, words: int) -> list[tuple[str, str]]:
    rng = np.random.default_rng(5)
    return [(name, " ".join("".join(map(chr, rng.choice(codes, rng.integers(2, 9)))) for _ in range(words)))
            for name, codes in LETTERS.items() for _ in range(n)]


def test_unlearned_languages_go_and_short_clean_texts_stay(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(10**9 + k, text, name) for k, (name, text) in enumerate([*unlearned(50, 200), *(("short", s) for s in SHORT)])]
    planted = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.length("text").alias("n_chars"))
    kept = corpus_pipeline.language(spark, docs.unionByName(planted.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])), "")
    by = {r["source"]: r["n"] for r in kept.where("doc_id >= 1000000000").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by == {"short": len(SHORT)}
    assert kept.where("doc_id < 1000000000").count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_too_few_training_texts_tell_nothing(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "en")], "doc_id long, text string, lang string")
    assert language_id.decidable(docs, language_id.train(docs)) == float("inf")
    assert language_id.decidable(docs.limit(0), {}) == float("inf")


def test_trigrams_count_effectively():
    n = language_id.Bundler().counted(["", "A.", "wort " * 1000, "abcdefghijklmnopqrstuvwxyz"])[1]
    assert n[0] == 0 and abs(n[1] - 1) < 0.01 and 3 < n[2] < 7 and 20 < n[3] < 33
