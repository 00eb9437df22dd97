"""Ordered statistics of large columns: running sums and exact ranks, without a window over a column.

``running`` deals the rows to value ranges by sampled boundaries (Spark's range partitioner), sums each
range, turns the sums into offsets (a table of ranges x parts) and adds a running sum inside the
range. Distinct values decide the ranges, so an outlier or a hot value makes no range larger.

``values_at_ranks`` finds exact order statistics by counting: each pass counts the rows of every open
bracket in equal-width buckets and keeps, per rank, the bucket that holds it, narrowed to the values it
really has. Rows are never sorted or moved; all ranks share the passes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.operators.attach import attach
from rowsift.session import cut_lineage

BUCKETS = 1024


def running(df: DataFrame, part: Sequence[str], v: str, sums: Sequence[str]) -> DataFrame:
    """``df`` (one row per part and value, no null values) with ``cum_<c>``, the sum of c over the values up to this
    one, for each of ``sums``, and ``next_v``, the next larger value of the part. Integer columns stay exact."""
    part = list(part)
    dealt = cut_lineage(df.repartitionByRange(*part, v).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*part, "_range").agg(F.min(v).alias("_first"), *[F.sum(c).alias(f"_total_{c}") for c in sums])
    by_range = Window.partitionBy(*part).orderBy("_range")  # ranges of a part, not rows
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_range", F.lead("_first").over(by_range).alias("_next"),
                            *[F.coalesce(F.sum(f"_total_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    inside = Window.partitionBy("_range", *part).orderBy(v)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = attach(dealt, offsets, [*part, "_range"])
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums],
                      F.coalesce(F.lead(v).over(inside), F.col("_next")).alias("next_v"))


def values_at_ranks(df: DataFrame, v: str, ranks: Sequence[int], buckets: int = BUCKETS) -> dict[int, float]:
    """rank (from 0, rising) -> value of column ``v``; null and NaN values have no rank."""
    at = cut_lineage(df.select(F.col(v).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "ranked")
    ends = at.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    wanted = sorted(set(ranks))
    if wanted and (wanted[0] < 0 or wanted[-1] >= ends["n"]):
        raise ValueError(f"ranks must lie in 0..{ends['n'] - 1}")
    brackets = [(ends["lo"], ends["hi"], 0, wanted)] if wanted else []  # values lo..hi, rows below, ranks inside
    found: dict[int, float] = {}
    while brackets:
        for lo, hi, _, inside in brackets:
            if lo == hi:
                found.update(dict.fromkeys(inside, lo))
        brackets = [b for b in brackets if b[0] != b[1]]
        if not brackets:
            break
        x = F.col("v")
        which, place = F.lit(None).cast("int"), F.lit(0)
        for k, (lo, hi, _, _) in enumerate(brackets):
            inside, width = (x >= lo) & (x <= hi), hi / 2 - lo / 2
            share = (x / 2 - lo / 2) / width if math.isfinite(width) and width > 0 else F.when(x == hi, 1.0).when(x > lo, 0.5).otherwise(0.0)
            which = F.when(inside, F.lit(k)).otherwise(which)
            place = F.when(inside, F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(place)
        counted = (at.select(which.alias("k"), place.cast("int").alias("b"), "v").where("k IS NOT NULL").groupBy("k", "b")
                   .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "b").collect())  # ranks x buckets rows
        narrowed = []
        for k, (_, _, below, inside) in enumerate(brackets):
            for r in counted:
                if r["k"] == k:
                    mine = [q for q in inside if below <= q < below + r["n"]]
                    if mine:
                        narrowed.append((r["lo"], r["hi"], below, mine))
                    below += r["n"]
        brackets = narrowed
    return found


def quantiles(df: DataFrame, v: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles, linear between neighbouring ranks (share * (n - 1)); empty without a value."""
    n = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).count()
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    at = values_at_ranks(df, v, [int(f(p)) for p in places for f in (math.floor, math.ceil)])
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def quantiles_by(df: DataFrame, part: Sequence[str], v: str, shares: Sequence[float]) -> DataFrame:
    """part..., q (array): exact quantiles per part, linear between neighbouring ranks, from running counts: one row
    per part, however many parts there are."""
    part = list(part)
    per = df.select(*part, F.col(v).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    per = cut_lineage(per.groupBy(*part, "_v").agg(F.count("*").alias("_c")), "value-counts")
    at = attach(running(per, part, "_v", ["_c"]), per.groupBy(*part).agg(F.sum("_c").alias("_n")), part)
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("p")) for k, s in enumerate(shares)])
    mine = F.filter(places, lambda x: (F.floor(x["p"]) >= F.col("cum__c") - F.col("_c")) & (F.floor(x["p"]) < F.col("cum__c")))
    hit = at.select(*part, "_v", "next_v", "cum__c", F.explode(mine).alias("x"))
    upper = F.when(F.ceil("x.p") < F.col("cum__c"), F.col("_v")).otherwise(F.col("next_v"))
    between = F.col("x.p") - F.floor("x.p")
    value = F.when(between == 0, F.col("_v")).otherwise(F.col("_v") + between * (upper - F.col("_v")))
    return hit.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct(F.col("x.k").alias("k"), value.alias("v")))).alias("q")) \
        .select(*part, F.transform("q", lambda x: x["v"]).alias("q"))  # one entry per share
