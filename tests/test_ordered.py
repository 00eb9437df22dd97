"""Running sums, exact ranks and attached values against pandas / numpy, and how they spread."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsift.operators import ordered, report
from rowsift.operators import quality as qm
from rowsift.operators.attach import attach, measured_bytes


def test_running_with_an_outlier(spark):
    rng = np.random.default_rng(1)
    values = {"a": np.unique(rng.normal(size=4000)).tolist() + [1e12], "b": [5.0], "c": list(map(float, range(300)))}
    rows = [(p, v, int(k * 7 % 11)) for p, vs in values.items() for k, v in enumerate(vs)]
    got = ordered.running(spark.createDataFrame(rows, "part string, v double, n long").repartition(7), ["part"], "v", ["n"])
    out = {(r["part"], r["v"]): (r["cum_n"], r["next_v"]) for r in got.collect()}
    assert len(out) == len(rows)
    for p in values:
        mine = sorted((v, n) for q, v, n in rows if q == p)
        total = 0
        for k, (v, n) in enumerate(mine):
            total += n
            assert out[p, v] == (total, mine[k + 1][0] if k + 1 < len(mine) else None)


def test_ranges_are_even(spark):
    df = spark.range(40_000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 1e6).alias("v"), F.lit(1).alias("n"), F.lit("x").alias("part"))
    sizes = [r["count"] for r in df.repartitionByRange(16, "part", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 40_000 / 8


def test_ranks(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3000).tolist() + [1e12, -1e300, 1.7e308], [3.0] * 500 + [4.0] * 3, [5e-324, 0.0, 1e-323, 5e-324], [7.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        order = sorted(values)
        ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
        assert ordered.values_at_ranks(df, "v", ranks, buckets=16) == {r: order[r] for r in ranks}
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    df = spark.createDataFrame([(float(v),) for v in range(17)], "v double")
    assert ordered.quantiles(df, "v", shares) == pytest.approx(np.quantile(range(17), shares).tolist())
    assert ordered.quantiles(df.limit(0), "v", shares) == []
    with pytest.raises(ValueError):
        ordered.values_at_ranks(df, "v", [17])


def test_attach(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    per = df.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted((r["id"], r["n"]) for r in df.alias("d").join(per.alias("p"), F.expr("d.k <=> p.k")).collect())
    for limit in (1 << 20, 0):
        assert sorted((r["id"], r["n"]) for r in attach(df, per, ["k"], limit=limit).collect()) == want
    assert measured_bytes(spark.createDataFrame([("ab", 1, None)], "s string, i int, t string")) == 26
    assert attach(df, per.where("k = 'hot'"), ["k"]).where("k <> 'hot' AND n IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        attach(df, per, [])


def test_rows_do_not_move_by_key(spark):
    """With a broadcast threshold of 20 kB, thresholds, ranges and scalars reach the rows without an exchange by key."""
    from rowsift.operators import dynamics as dyn
    from rowsift.operators import sampling as smp
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") < 4000, "s").otherwise("t").alias("source"), (F.col("id") / 7000).alias("confidence"),
                                      F.lit(0.1).alias("aleatoric"), F.lit(0.2).alias("entropy"), F.lit(0.1).alias("variability"))
        plans = {"mi": dyn.add_mi(df, ["source"]), "threshold": dyn.assign_groups(df, xthresh=0, by=["source"]),
                 "z": report.drop_outliers(df, ["source"], "confidence"), "remainder": smp.stratified_split(df, "y", 5, "id")[1].where("id >= 0")}
        for name, out in plans.items():
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, name
            for key in ("source", "y"):
                assert f"hashpartitioning({key}#" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_trend_is_polyfit(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 400, size=200)
    y = 3 + 0.2 * x - 1e-3 * x**2 + 2e-6 * x**3 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), "g") for a, b in zip(x, y)] + [(1.0, 2.0, "few"), (2.0, 2.0, "few"), (None, 1.0, "g")], "x double, y double, g string")
    assert report.cubic_trend(df.where("g = 'g'"), "x", "y") == pytest.approx(np.polyfit(x, y, 3).tolist(), rel=1e-6)
    assert [r["g"] for r in report.polynomial_trend(df, "x", "y", ["g"]).where("c0 IS NULL").collect()] == ["few"]
    assert report.cubic_trend(df.where("g = 'few'"), "x", "y") == []


def test_rbf_exact_and_approximate(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) + 0.5
    kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1)).mean()
    want = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    frame = lambda m: spark.createDataFrame([(v.tolist(), *map(float, v)) for v in m], "x array<double>, c0 double, c1 double, c2 double")
    for block in (1024, 64):
        assert qm.mmd_rbf(frame(a), frame(b), "x", block=block).first()["score"] == pytest.approx(want, rel=1e-9)
    assert abs(qm.mmd_rbf_rff(frame(a), frame(b), ["c0", "c1", "c2"], n_features=256).first()["score"] - want) < 1 / np.sqrt(256)
    assert qm.mmd_rbf(frame(a), frame(b).limit(0), "x").first()["score"] is None


def test_survival(spark):
    rows = [("a", t, e) for t, e in [(1, 1), (1, 0), (2, 1), (3, 0), (4, 1)]] + [("b", 1, 0), ("b", 5, 0)]
    got = {(r["source"], r["t"]): r["survival"] for r in qm.kaplan_meier(spark.createDataFrame(rows, "source string, t int, e int"), "t", "e").collect()}
    assert got == {("a", 1.0): pytest.approx(4 / 5), ("a", 2.0): pytest.approx(4 / 5 * 2 / 3), ("a", 3.0): pytest.approx(4 / 5 * 2 / 3),
                   ("a", 4.0): 0.0, ("b", 1.0): 1.0, ("b", 5.0): 1.0}


def test_auc_falls_back_to_the_prediction(spark):
    from rowsift.operators import evaluate as ev
    rows = [("s", "c", 1, 1, None), ("s", "c", 0, 0, None), ("s", "c", 1, 0, None), ("s", "c", 0, 1, None), ("s", "d", 1, 1, 0.5)]
    got = {r["clf"]: r["auc"] for r in ev.roc_auc(spark.createDataFrame(rows, "source string, clf string, y int, y_pred int, score double")).collect()}
    assert got == {"c": 0.5, "d": 0.0}
