"""Replayable sampling and splits.

All order comes from ``h(key, seed)``; ties broken by the key. Scale notes:

* Per-class top-n (D1, C9) is ``row_number() <= n`` over (class ORDER BY h):
  Spark inserts a *partial* ``WindowGroupLimit`` before the shuffle, so a class
  that holds a third of the table only ships n rows per map task.
* D1's sample and remainder come from one hashed table, written once: the
  threshold ``(h, key, row hash)`` per class (one row per class, measured and
  broadcast by ``attach``) sends each row to its part in place. Rows equal to the
  threshold row are counted and dealt out from the count, in chunks.
* Exact global ranks (D3, D7, D10) use hash-prefix buckets: bucket counts
  (one tiny aggregate) -> prefix offsets -> rank inside the bucket. md5 is
  uniform, so buckets are even regardless of key skew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.functions.hashing import h, hex_threshold
from rowsift.operators.attach import attach
from rowsift.session import cut_lineage

NO_KEY = "0" * 32  # the hash of a null key


def with_hash(df: DataFrame, key: str, seed, name: str = "_h") -> DataFrame:
    return df.withColumn(name, F.coalesce(h(key, seed), F.lit(NO_KEY)))


COPIES = 10_000  # copies of one row written out by one chunk


# ------------------------------------------------------------------ D1
def stratified_sample(df: DataFrame, label: str, n: int, key: str, seed=42) -> DataFrame:
    """Exactly ``n`` rows per class (all rows of smaller classes), chosen by h(key, seed)."""
    w = Window.partitionBy(label).orderBy(h(key, seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_split(df: DataFrame, label: str, n: int, key: str, seed=42):
    """(sample, remainder): sample = D1; remainder = every other row of the class.

    A key may repeat: ties go by a hash of the whole row, and of equal rows as many go to the sample as
    it still takes, so each row is in exactly one part.
    """
    cols = df.columns
    at = cut_lineage(with_hash(df, key, seed).withColumn("_r", F.xxhash64(*cols)), "hashed")
    order = F.struct(F.col("_h").alias("h"), F.col(key).alias("key"), F.col("_r").alias("r"))
    slim = at.select(label, order.alias("_o"))
    w = Window.partitionBy(label).orderBy("_o")
    top = slim.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)  # n rows per class leave a map task
    last = (top.groupBy(label, "_o").agg(F.count("*").alias("_m")).groupBy(label).agg(F.max(F.struct("_o", "_m")).alias("_last")))
    marked = attach(at.withColumn("_o", order), last, [label])
    below, above = F.col("_o") < F.col("_last._o"), F.col("_last").isNull() | (F.col("_o") > F.col("_last._o"))
    equal = marked.where(F.col("_o") == F.col("_last._o")).groupBy(*cols, F.col("_last._m").alias("_m")).agg(F.count("*").alias("_n"))
    equal = cut_lineage(equal, "threshold-rows")

    def copies(count):
        at_chunk = equal.withColumn("_k", count).where("_k > 0")
        starts = F.sequence(F.lit(0).cast("long"), F.col("_k") - 1, F.lit(COPIES).cast("long"))
        chunks = at_chunk.withColumn("_from", F.explode(starts)).repartition("_from")
        return chunks.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least("_k", F.col("_from") + COPIES) - 1))).select(*cols)

    return (marked.where(below).select(*cols).unionByName(copies(F.col("_m"))),
            marked.where(above).select(*cols).unionByName(copies(F.col("_n") - F.col("_m"))))


# ------------------------------------------------------------------ D2
def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def sample_and_split(df: DataFrame, label: str, n: int, key: str, seed=100):
    """D1 with the guard: ``n`` larger than the smallest class raises ValueError."""
    smallest = class_counts(df, label).agg(F.min("n")).first()[0]
    if smallest is not None and n > smallest:
        raise ValueError(f"n_samples_per_class={n} exceeds the smallest class size {smallest}")
    return stratified_split(df, label, n, key, seed)


# ------------------------------------------------------------------ exact global rank
RANK_PREFIX = 4  # 16**4 = 65,536 hash buckets: ~1.5M rows per bucket at 1e11 rows


def hash_rank_n(df: DataFrame, key: str, seed, col: str = "idx") -> tuple[DataFrame, int]:
    """(df + 0-based rank by (h(key, seed), key), row count), without a global sort.

    Bucket = first 4 hex chars of the hash (uniform whatever the key skew);
    one aggregate gives the bucket counts (<= 65,536 rows, the only thing
    collected) and the total; offsets are their prefix sums; the rank is
    offset + row_number inside the bucket.
    """
    hashed = with_hash(df, key, seed).withColumn("_b", F.substring("_h", 1, RANK_PREFIX))
    counts = hashed.groupBy("_b").count().collect()  # <= 16**RANK_PREFIX rows
    acc, rows = 0, []
    for r in sorted(counts, key=lambda r: r["_b"]):
        rows.append((r["_b"], acc))
        acc += r["count"]
    offsets = df.sparkSession.createDataFrame(rows, "_b string, _off long")
    w = Window.partitionBy("_b").orderBy("_h", key)
    ranked = (hashed.join(F.broadcast(offsets), "_b")
                    .withColumn(col, F.col("_off") + F.row_number().over(w) - 1)
                    .drop("_b", "_off", "_h"))
    return ranked, acc


def hash_rank(df: DataFrame, key: str, seed, col: str = "idx") -> DataFrame:
    return hash_rank_n(df, key, seed, col)[0]


def hash_rank_within(df: DataFrame, by: Sequence[str], key: str, seed: Column, col: str = "idx", prefix: int = 2) -> DataFrame:
    """0-based rank by (h(key, seed), key) inside each group; ``seed`` may depend on the group. Groups are split
    into 16**prefix hash buckets, so that a group of any size is spread; offsets come from the bucket counts."""
    hashed = df.withColumn("_h", F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), seed)), F.lit(NO_KEY)))
    hashed = cut_lineage(hashed.withColumn("_b", F.substring("_h", 1, prefix)), "ranked")
    counts = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 16**prefix rows a group
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_b").orderBy("_h", key)
    return attach(hashed, offsets, [*by, "_b"]).withColumn(col, F.col("_off") + F.row_number().over(w) - 1).drop("_b", "_off", "_h")


# ------------------------------------------------------------------ D3
def random_split(df: DataFrame, key: str, test_size: float = 0.5, seed=42, exact: bool = True):
    """(train, test); test gets ceil(test_size * n) rows (exact) or ~test_size (hash threshold)."""
    if not exact:
        hh = F.substring(h(key, seed), 1, 8)
        cut = hex_threshold(1 - test_size)
        return df.where(hh < cut), df.where(hh >= cut)
    split = _with_part(df, key, test_size, seed)
    return split.where("_first").drop("_first"), split.where("NOT _first").drop("_first")


def _with_part(df: DataFrame, key: str, test_size: float, seed) -> DataFrame:
    """``_first``: whether the rank by (h(key, seed), key) is below n - ceil(test_size * n). The hash bucket says it for
    all buckets but the one that holds this rank; only that one is ranked, and no other row is moved."""
    hashed = with_hash(df, key, seed).withColumn("_b", F.substring("_h", 1, RANK_PREFIX))
    counts = {r["_b"]: r["count"] for r in hashed.groupBy("_b").count().collect()}  # <= 16**RANK_PREFIX rows
    n = sum(counts.values())
    left, at = n - math.ceil(test_size * n), ""
    for at in sorted(counts):
        if counts[at] > left:
            break
        left -= counts[at]
    else:
        return df.withColumn("_first", F.lit(True))
    inside = hashed.where(F.col("_b") == at).withColumn("_first", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) <= left)
    clear = hashed.where(F.col("_b") != at).withColumn("_first", F.col("_b") < at)
    return clear.unionByName(inside).drop("_b", "_h")


def split_role(df: DataFrame, key: str, test_size: float = 0.5, seed=42,
               roles=("oracle", "test")) -> DataFrame:
    """D3 as a column: rank < n_train -> roles[0] else roles[1]."""
    return _with_part(df, key, test_size, seed).withColumn("role", F.when(F.col("_first"), roles[0]).otherwise(roles[1])).drop("_first")


# ------------------------------------------------------------------ D4
def assign_roles(df: DataFrame, label: str, n: int, key: str, seed=42,
                 test_size: float = 0.5) -> DataFrame:
    """original (n per class) / oracle / test roles in one table."""
    sample, rest = stratified_split(df, label, n, key, seed)
    rest = split_role(rest, key, test_size, seed, roles=("oracle", "test"))
    return sample.withColumn("role", F.lit("original")).unionByName(rest)


# ------------------------------------------------------------------ D5
def fraction_sample(df: DataFrame, key: str, frac: float, seed=42) -> DataFrame:
    """~frac of the rows by hash threshold (replayable, no shuffle)."""
    return df.where(F.substring(h(key, seed), 1, 8) < hex_threshold(frac))


# ------------------------------------------------------------------ D6
def balanced_sample(df: DataFrame, label: str, prop: float, per_class_full: int, key: str,
                    seed=42) -> DataFrame:
    """n = int(prop * per_class_full) rows per class, shuffled (hash order), new 0-based ids."""
    n = int(prop * per_class_full)
    s = cut_lineage(stratified_sample(df, label, n, key, seed), "balanced")
    return hash_rank(s, key, f"{seed}|shuffle", "row_id")


# ------------------------------------------------------------------ D7 / D8
def bootstrap(df: DataFrame, key: str, n: int, iterations: int = 1, seed=42,
              compounding: bool = False) -> DataFrame:
    """Draw ``n`` rows with replacement per iteration: (iter, draw, row...).

    Independent draws (default): one draws table of iterations * n rows, an
    equi-join on the exact rank. ``compounding=True`` (the reference's quirk):
    each iteration draws from the previous iteration's draws.
    """
    spark = df.sparkSession
    if not compounding:
        ranked, total = hash_rank_n(df, key, seed, "_idx")
        draws = (spark.range(iterations * n)
                 .select((F.col("id") / n).cast("int").alias("iter"), (F.col("id") % n).cast("int").alias("draw")))
        pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("boot"), F.col("iter"), F.col("draw"),
                                                           F.lit(str(seed)))), 1, 15), 16, 10).cast("long"),
                      F.lit(total))
        draws = draws.withColumn("_idx", pick)
        return draws.join(ranked, "_idx").drop("_idx")
    pool = df
    out = None
    for it in range(iterations):
        cur = bootstrap(pool.drop(*[c for c in ("iter", "draw") if c in pool.columns]), key, n, 1,
                        seed=f"{seed}|{it}", compounding=False)
        cur = cur.withColumn("iter", F.lit(it))
        out = cur if out is None else out.unionByName(cur)
        pool = cur.drop("iter", "draw")
    return out


# ------------------------------------------------------------------ D9
def shuffle(df: DataFrame, key: str, seed=42) -> DataFrame:
    """Deterministic full shuffle (range-partitioned distributed sort)."""
    return df.orderBy(h(key, seed), F.col(key))


# ------------------------------------------------------------------ D10
def size_match(a: DataFrame, b: DataFrame, key: str, seed=42):
    """Sample the larger table down to the smaller one's row count (exact hash rank)."""
    na, nb = a.count(), b.count()
    if na > nb:
        return hash_rank(a, key, seed, "_idx").where(F.col("_idx") < nb).drop("_idx"), b
    if nb > na:
        return a, hash_rank(b, key, seed, "_idx").where(F.col("_idx") < na).drop("_idx")
    return a, b


# ------------------------------------------------------------------ C9
def cap_per_group(df: DataFrame, cap: int, key: str, by: Sequence[str] = ("source",), seed=42) -> DataFrame:
    """Keep at most ``cap`` rows per group by hash order (whole group when smaller)."""
    w = Window.partitionBy(*by).orderBy(h(key, seed), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")
