"""Values of operators whose queries have no SQL or see no odd input there."""
import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from rowsift.functions import encode as en
from rowsift.operators import completions as cp
from rowsift.operators import evaluate as ev
from rowsift.operators import oversample as ov
from rowsift.operators import quality as qm
from rowsift.operators import report as rp
from rowsift.plans.q_quality import chi_sql


def test_chi_squared_tail(spark):
    """Against the usual table of critical values, and against numeric integration of the density."""
    known = [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.070498, 5, 0.05),
             (16.918978, 9, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.000157, 1, 0.99)]

    def integral(x, dof):
        t = np.linspace(x, x + 40 * math.sqrt(2 * dof) + 200, 2_000_001)
        y = np.exp((dof / 2 - 1) * np.log(t) - t / 2 - dof / 2 * math.log(2) - math.lgamma(dof / 2))
        return float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum())
    known += [(x, d, integral(x, d)) for d in (1, 2, 7, 12, 33) for x in (0.5, 3.0, 20.0, 60.0)]
    df = spark.createDataFrame([(float(x), d, float(p)) for x, d, p in known], "x double, dof long, p double")
    for r in df.withColumn("got", qm.chi_squared_tail(F.col("x"), F.col("dof"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-5 if r["p"] in (0.05, 0.01, 0.99) else 1e-7), r
    edge = spark.createDataFrame([(0.0, 3, ), (1e9, 3), (1e9, 4), (1e-12, 1), (5.0, 0)], "x double, dof long")
    got = [r[0] for r in edge.select(qm.chi_squared_tail(F.col("x"), F.col("dof"))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] == 0 and got[3] == pytest.approx(1, abs=1e-5) and got[4] is None


def test_chi_squared_sql_merges_empty_bins(spark):
    rng = np.random.default_rng(5)
    real = spark.createDataFrame([(float(v), 1.0) for v in [0, 100, *rng.normal(50, 4, 300)]], "x double, y double")
    syn = spark.createDataFrame([(float(v), 1.0) for v in [*rng.uniform(-20, 120, 50), *rng.normal(50, 5, 300)]], "x double, y double")
    hist = qm.histograms(real, syn, ["x", "y"])
    got = {r["col"]: r for r in qm.chi_squared(hist).collect()}
    planted = hist.toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.connect().execute(chi_sql("SELECT * FROM planted")).df().set_index("col")
    assert got["x"]["outside"] > 0 and want.loc["x", "outside"] == got["x"]["outside"] and want.loc["x", "dof"] == got["x"]["dof"]
    assert want.loc["x", "statistic"] == pytest.approx(got["x"]["statistic"], abs=1e-6) and want.loc["x", "p_value"] == pytest.approx(got["x"]["p_value"], abs=1e-6)
    assert got["y"]["dof"] == 0 and got["y"]["p_value"] is None and pd.isna(want.loc["y", "p_value"])


def test_per_classifier_table(spark):
    rows = [("a", "gbt", 0.5, 0.1), ("a", "rf", 0.7, 0.3), ("a", "dt", 0.9, 0.9), ("b", "rf", 0.6, None)]
    m = spark.createDataFrame(rows, "source string, clf string, accuracy double, auc double")
    got = {(r["source"], r["metric"]): (r["gbt"], r["rf"], r["lr"], r["dt"], r["mean"]) for r in
           ev.per_classifier(m, ("gbt", "rf", "lr", "dt"), cols=("accuracy", "auc")).collect()}
    assert got["a", "accuracy"] == (0.5, 0.7, None, 0.9, pytest.approx(0.6)) and got["a", "auc"] == (0.1, 0.3, None, 0.9, pytest.approx(0.2))
    assert got["b", "accuracy"] == (None, 0.6, None, None, 0.6) and got["b", "auc"] == (None,) * 5


def test_evaluate_model_counts_its_own_predictions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + b / 2 + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "rid long, a double, b double, y int")
    train, test = df.where("rid < 300"), df.where("rid >= 300")
    lr = LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=50)
    got = ev.evaluate_model(train, test, ["a", "b"], "y", lr).first()
    p = ev.fit_predict(train, test, ["a", "b"], "y", lr).toPandas()
    pos, neg = p[p.y == 1].score.to_numpy(), p[p.y == 0].score.to_numpy()
    assert got["n"] == 100 and got["accuracy"] == pytest.approx((p.y == p.y_pred).mean()) and got["accuracy"] > 0.65
    assert got["precision"] == pytest.approx(p[p.y_pred == 1].y.mean()) and got["recall"] == pytest.approx(p[p.y == 1].y_pred.mean())
    assert got["auc"] == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))


def test_evaluate_model_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    df = spark.range(200).select(F.col("id").alias("rid"), F.udf(noted, "double")(F.sin("id")).alias("a"), (F.sin("id") + F.sin(F.col("id") * 7) > 0.5).cast("int").alias("y"))
    lr = LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=5)
    assert ev.evaluate_model(df.where("rid < 100"), df.where("rid >= 100"), ["a"], "y", lr).first()["n"] == 100
    assert seen.value == 200  # neither the passes of the fit nor the two metrics run the plan again


def test_pca_map_is_the_projection_on_two_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 100, 1]
    df = spark.createDataFrame([(i, "s", *map(float, r)) for i, r in enumerate(x)], "rid long, source string, a double, b double, c double, d double")
    got = np.array([(r["x1"], r["x2"]) for r in rp.pca_map(df, ["a", "b", "c", "d"]).orderBy("rid").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, v = np.linalg.eigh(np.cov(z.T))
    for k in range(2):
        want = z @ v[:, -1 - k]
        assert np.allclose(got[:, k], want, atol=1e-8) or np.allclose(got[:, k], -want, atol=1e-8)


def test_nominal_codes_of_nulls(spark):
    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "c", "b", None, ""]], "v string")
    got = {r["v"]: r["code"] for r in en.nominal_codes(df, "v", "code").collect()}
    assert got == {"": 0, "a": 1, "b": 2, "c": 3, None: -1}
    assert {r["code"] for r in en.nominal_codes(df.where("v IS NULL"), "v", "code").collect()} == {-1}


def test_prompts(spark):
    descs = cp.descriptors(["age", "y"], "y", "died within a year")
    assert descs == [("age", "age", "feature column"), ("y", "target", "died within a year")]
    assert cp.descriptors(["y"], "y", rename_label_to=None)[0][1] == "y"
    told = cp.format_instructions(descs)
    assert '"age": feature column' in told and '"target": died within a year' in told
    rows = spark.createDataFrame([("a", 2, 0), ("a", 1, 1), ("b", 3, None)], "set string, age int, y int")
    batches = cp.serialise_records(rows, ["set"], ["age", "y"])
    assert {r["set"]: json.loads(r["data"]) for r in batches.collect()} == {"a": [{"age": 1, "y": 1}, {"age": 2, "y": 0}], "b": [{"age": 3}]}
    templates = spark.createDataFrame([("a", "first line\nRows: {data}\n{format_instructions}")], "set string, template string")
    got = {r["set"]: r["user"] for r in cp.build_prompts(batches, templates, "plain {data}", told, dataset_col="set").collect()}
    assert got["a"].split("\n")[0] == "first line" and got["a"].endswith(told) and json.loads(got["b"].removeprefix("plain ")) == [{"age": 3}]
    got = {r["set"]: r["user"] for r in cp.build_prompts(batches, templates, "x\n{data}", told, dataset_col="set", strip_first_line=True).collect()}
    assert got["a"].startswith("Rows: ") and "\n" not in got["a"] and json.loads(got["b"]) == [{"age": 3}]


def test_rounds_are_limited_and_rows_return(spark):
    rows = spark.createDataFrame([("s", it, f"{it}{k}") for it in range(5) for k in range(3)], "source string, iter int, row string")
    assert sorted({r["iter"] for r in cp.quota_cut(rows, 100, max_rounds=2).collect()}) == [0, 1]
    assert sorted({r["iter"] for r in cp.quota_cut(rows, 4, max_rounds=4).collect()}) == [0, 1]
    again = sorted((r["round"], r["row"]) for r in cp.reaccumulate(rows).collect())
    assert again == sorted((n, f"{it}{k}") for n in range(5) for it in range(n + 1) for k in range(3))


def test_generators(spark):
    train = spark.createDataFrame([(f"r{i}", i) for i in range(10)], "rid string, y int")
    with pytest.raises(ValueError, match="unknown generator"):
        ov.run_generators(train, ["nothing"], 5)
    ov.register_generator("constant", lambda t, n, key="rid", **kw: t.sparkSession.range(n).select(F.lit(7).alias("y")))
    try:
        got = [(r["source"], r["rid"], r["y"]) for r in ov.run_generators(train, ["constant", "bootstrap"], 4).collect()]
    finally:
        del ov.GENERATORS["constant"]
    assert sorted(x for x in got if x[0] == "Original") == sorted(("Original", f"r{i}", i) for i in range(10))
    assert [x for x in got if x[0] == "constant"] == [("constant", None, 7)] * 4
    drawn = [x for x in got if x[0] == "bootstrap"]
    assert len(drawn) == 4 and all(rid == f"r{y}" for _, rid, y in drawn)
