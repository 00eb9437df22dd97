"""Oversampling and the generator registry (O1, O2).

SMOTE brings each class *up to* ``n`` rows: every synthetic row interpolates
between a hashed base row of the class and one of its ``k`` nearest
same-class neighbours (exact, pivot-pruned; see ``distance.py``) with a
hashed ``u`` in [0, 1). Replayable; no Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.functions.hashing import unit_float
from rowsift.operators import distance as dst
from rowsift.operators import sampling as smp
from rowsift.operators.attach import attach
from rowsift.session import cut_lineage


def _hash_int(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


CHUNK = 10_000  # draws written out by one row


def smote(df: DataFrame, id_col: str, vec: str, label: str, n: int | None = 1000, k: int = 4, seed: int = 42,
          n_pivots: int | None = None) -> DataFrame:
    """Originals plus synthetic rows so that each class has ``n`` rows (``is_synthetic`` flag); with ``n=None`` twice the
    rows of the largest class. ``base_id``, ``nb_id`` and ``u`` say where a synthetic row comes from.

    All classes share one neighbour search: the class is a further coordinate, wider than any distance
    inside a class, so that cells of other classes are pruned and only rows of the class come first.
    A class already larger than ``n`` raises, as the reference's sampler does; a class of one row is copied.
    """
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"), F.col(label).alias("label")), "smote-rows")
    classes = rows.groupBy("label").agg(F.count("*").alias("cnt"))
    largest = classes.agg(F.max("cnt").alias("m")).first()["m"] or 0
    n = 2 * largest if n is None else n
    if largest > n:
        raise ValueError(f"classes already above n={n}: {[r['label'] for r in classes.where(F.col('cnt') > n).limit(10).collect()]}")
    code = Window.orderBy("label")  # one row per class
    classes = cut_lineage(classes.select("label", "cnt", (n - F.col("cnt")).alias("need"), F.least(F.lit(k), F.col("cnt") - 1).alias("kk"),
                                         (F.row_number().over(code) - 1).alias("code")), "smote-classes")
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    wide = 4 * math.sqrt(rows.agg(F.coalesce(F.max(norm), F.lit(0.0)).alias("m")).first()["m"]) + 1
    apart = attach(rows, classes.select("label", "code"), ["label"])
    apart = cut_lineage(apart.withColumn("xc", F.concat("x", F.array(F.col("code") * F.lit(wide)))), "smote-space")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1, F.lit(CHUNK).cast("long")))
    chunks = classes.where("need > 0").select("label", "cnt", "need", "kk", starts.alias("from")).repartition("label", "from")
    draws = chunks.select("label", "cnt", "kk", F.explode(F.sequence(F.col("from"), F.least("need", F.col("from") + CHUNK) - 1)).alias("s"))
    cls, sd = F.col("label").cast("string"), F.lit(str(seed))
    draws = draws.select("label", "s", "kk", F.pmod(_hash_int(F.lit("smote"), cls, F.col("s"), sd), F.col("cnt")).alias("idx"),
                         (F.pmod(_hash_int(F.lit("nb"), cls, F.col("s"), sd), F.greatest("kk", F.lit(1))) + 1).cast("int").alias("rank"),
                         unit_float(F.md5(F.concat_ws("|", F.lit("u"), cls, F.col("s"), sd))).alias("u"))
    ranked = smp.hash_rank_within(rows, ["label"], "id", F.concat(sd, F.lit("|"), cls), "idx")
    base = draws.join(ranked.select("label", "idx", F.col("id").alias("base_id"), "x"), ["label", "idx"])
    found = dst.knn(apart, apart.withColumnRenamed("id", "nb_id"), k, "id", "nb_id", "xc", exclude_self=True, n_pivots=n_pivots)
    found = found.where(F.col("d") < wide).join(rows.select(F.col("id").alias("nb_id"), F.col("x").alias("nx")), "nb_id")  # of the same class
    near = base.join(found.select(F.col("id").alias("base_id"), "rank", "nb_id", "nx"), ["base_id", "rank"], "left")
    mixed = F.when(F.col("kk") > 0, F.zip_with("x", "nx", lambda a, b: a + F.col("u") * (b - a))).otherwise(F.col("x"))
    made = near.select(F.concat(F.lit("smote|"), cls, F.lit("|"), F.col("s").cast("string")).alias(id_col), mixed.alias(vec), F.col("label").alias(label),
                       F.lit(1).alias("is_synthetic"), "base_id", "nb_id", "u")
    given = rows.select(F.col("id").cast("string").alias(id_col), F.col("x").alias(vec), F.col("label").alias(label), F.lit(0).alias("is_synthetic"))
    return given.unionByName(made, allowMissingColumns=True)


# ------------------------------------------------------------------ O2
def bootstrap_generator(train: DataFrame, n: int, key: str = "rid", seed: int = 42) -> DataFrame:
    return smp.bootstrap(train, key, n, iterations=1, seed=seed).drop("iter", "draw")


GENERATORS: dict[str, Callable[..., DataFrame]] = {"bootstrap": bootstrap_generator}


def register_generator(name: str, fn: Callable[..., DataFrame]) -> None:
    GENERATORS[name] = fn


def run_generators(train: DataFrame, names: Sequence[str], n: int, key: str = "rid", **kw) -> DataFrame:
    """``name -> fn(train, n) -> rows``; all outputs in one long table tagged with ``source``."""
    out = train.withColumn("source", F.lit("Original"))
    for name in names:
        if name not in GENERATORS:
            raise ValueError(f"unknown generator {name!r}; registered: {sorted(GENERATORS)}")
        g = GENERATORS[name](train, n, key=key, **kw).withColumn("source", F.lit(name))
        out = out.unionByName(g, allowMissingColumns=True)
    return out
