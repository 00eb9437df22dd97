import math

import pytest
from pyspark.sql import functions as F

from rowsift.operators import sampling as smp
from rowsift.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_stratified_split_exact_and_disjoint(spark):
    f1 = fx.labelled(spark, SF_SMALL)
    s, r = smp.stratified_split(f1, "y", 100, "rid", seed=3)
    assert {row["y"]: row["count"] for row in s.groupBy("y").count().collect()} == {0: 100, 1: 100}
    assert s.join(r, "rid").count() == 0
    assert s.count() + r.count() == f1.count()


def test_guard_raises(spark):
    f1 = fx.labelled(spark, SF_SMALL)
    import pytest
    with pytest.raises(ValueError):
        smp.sample_and_split(f1, "y", 10 ** 7, "rid")


def test_hash_rank_is_permutation(spark):
    f1 = fx.labelled(spark, SF_SMALL)
    r = smp.hash_rank(f1, "rid", 5, "idx")
    st = r.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.count("*")).first()
    assert (st[0], st[1], st[2]) == (0, st[3] - 1, st[3])


def test_random_split_sizes(spark):
    f1 = fx.labelled(spark, SF_SMALL)
    a, b = smp.random_split(f1, "rid", test_size=0.25, seed=1)
    n = f1.count()
    assert b.count() == -(-n // 4) and a.count() + b.count() == n


def test_bootstrap_and_cap(spark):
    f1 = fx.labelled(spark, SF_SMALL)
    boot = smp.bootstrap(f1, "rid", 50, iterations=2)
    assert boot.count() == 100
    capped = smp.cap_per_group(f1.withColumn("source", F.lit("x")), 7, "rid")
    assert capped.count() == 7


def test_split_of_repeated_keys_loses_no_row(spark):
    rows = [(f"k{i}", i % 2, i) for i in range(60)] + [("hot", 0, i % 7) for i in range(60)] + [("same", 1, 5)] * 60 + [(None, None, 1)] * 30
    df = spark.createDataFrame(rows, "rid string, y int, v int")
    for n in (0, 1, 10, 20, 40, 70, 500):
        s, r = smp.stratified_split(df, "y", n, "rid", seed=3)
        s, r = [[(x["rid"], x["y"], x["v"]) for x in part.collect()] for part in (s, r)]
        assert sorted(s + r, key=str) == sorted(rows, key=str)
        assert all(sum(x[1] == y for x in s) == min(n, sum(x[1] == y for x in rows)) for y in (0, 1, None))
    roles = smp.assign_roles(df.where("rid IS NOT NULL"), "y", 10, "rid", seed=3)
    assert sorted(((x["rid"], x["y"], x["v"]) for x in roles.collect()), key=str) == sorted((x for x in rows if x[0]), key=str)


def test_split_writes_out_many_copies(spark):
    df = spark.range(25_003).select(F.lit("same").alias("rid"), F.lit(1).alias("y"))
    s, r = smp.stratified_split(df, "y", 3, "rid")
    assert s.count() == 3 and r.count() == 25_000


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_split_ranks_one_bucket_only(spark, share, monkeypatch):
    monkeypatch.setattr(smp, "RANK_PREFIX", 1)  # 16 buckets, so that the bucket of the cut holds several rows
    df = spark.range(203).select(F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("k"))
    ranked, n = smp.hash_rank_n(df, "k", 5)
    want = sorted(ranked.where(F.col("idx") < n - math.ceil(share * n)).select("k").toPandas()["k"].fillna(""))
    first, second = smp.random_split(df, "k", share, 5)
    assert sorted(first.toPandas()["k"].fillna("")) == want and second.count() == n - len(want)
    roles = smp.split_role(df, "k", share, 5)
    assert sorted(roles.where("role = 'oracle'").toPandas()["k"].fillna("")) == want and roles.count() == n
    plan = smp._with_part(df, "k", share, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 1
