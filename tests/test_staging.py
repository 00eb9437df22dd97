"""Staged folds of fitted models by value: DuckDB folds the exported leaf ids and leaf values."""
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from rowsift.operators import staging
from rowsift.sources import fixtures as fx
from tests.conftest import SF_TINY

METRICS = ["confidence", "aleatoric", "variability", "correctness", "entropy"]


def models(spark, rows):
    train = rows.where("flip = 0").where("crc32(rid) % 3 = 0")
    yield "logit", staging.fit_gbt(train.where("y < 2"), fx.FEATURES, "y", nest=8, max_depth=4), rows.where("y < 2")
    yield "mean", staging.fit_forest(train, fx.FEATURES, "y", nest=8, max_depth=4), rows
    yield "ovr", staging.fit_gbt_per_class(train, fx.FEATURES, "y", 3, nest=5, max_depth=3), rows


def fold_in_duckdb(folder, kind):
    con = duckdb.connect()
    gold = {"logit": "1 / (1 + exp(-2 * (2 * y - 1) * s[1]))", "mean": "s[y + 1] / n", "ovr":
            "1 / (1 + exp(-2 * s[y + 1])) / list_sum([1 / (1 + exp(-2 * x)) FOR x IN s])"}[kind]
    return con.execute(f"""
        WITH x AS (SELECT k, y, unnest(_lf) AS leaf, unnest(range(len(_lf))) AS tree FROM '{folder}/rows/*.parquet'),
        j AS (SELECT k, y, step, i, v, FROM (SELECT k, y, step, unnest(range(1, len(value) + 1)) AS i, unnest(value) AS v
              FROM x JOIN '{folder}/values/*.parquet' l ON l.tree = x.tree AND l.leaf = x.leaf)),
        t AS (SELECT k, y, step, i, sum(v) AS v, count(*) AS n FROM j GROUP BY ALL),
        c AS (SELECT k, y, step, i, sum(v) OVER (PARTITION BY k, i ORDER BY step) AS s, sum(n) OVER (PARTITION BY k, i ORDER BY step) AS n FROM t),
        w AS (SELECT k, y, step, list(s ORDER BY i) AS s, min(n) AS n FROM c GROUP BY ALL),
        g AS (SELECT k, {gold} AS g FROM w WHERE step < (SELECT max(step) FROM w))
        SELECT k, avg(g) AS confidence, avg(g * (1 - g)) AS aleatoric, stddev_pop(g) AS variability, avg(CAST(g > 0.5 AS DOUBLE)) AS correctness,
               -sum(g * ln(g + 1e-12)) AS entropy FROM g GROUP BY k ORDER BY k""").df()


def test_models_fold_as_in_sql(spark):
    f1 = fx.labelled(spark, SF_TINY).where("crc32(rid) % 4 < 3").dropDuplicates(["rid"])
    f1 = f1.withColumn("y", F.when(F.col("l_quantity") > 38, 2).otherwise(F.col("y"))).withColumn("k", F.xxhash64("rid"))
    for kind, model, rows in models(spark, f1):
        assert staging.ensemble_kind(model) == kind
        folder = tempfile.mkdtemp(prefix="rowsift-leaves-", dir="/tmp")
        with_leaves, values = staging.with_leaves(model, rows), staging.leaf_values(model)
        with_leaves.select("k", "y", "_lf").write.parquet(f"{folder}/rows")
        values.write.parquet(f"{folder}/values")
        want = fold_in_duckdb(folder, kind)
        joined = staging.fold_leaves(with_leaves, values, kind, broadcast_leaves=0)
        for got in (staging.staged_dynamics(model, rows), joined):
            got = got.select("k", *METRICS).toPandas().sort_values("k").reset_index(drop=True)
            assert (got["k"] == want["k"]).all() and len(got) == rows.count()
            assert abs(got[METRICS] - want[METRICS]).max().max() < 1e-9, kind


def test_first_trees_are_the_smaller_model(spark):
    """Step i of the fold is the model with its first i trees."""
    f1 = fx.labelled(spark, SF_TINY).dropDuplicates(["rid"])
    train = f1.where("flip = 0").limit(500)
    big = staging.fit_gbt(train, fx.FEATURES, "y", nest=4, max_depth=3)
    small = staging.fit_gbt(train, fx.FEATURES, "y", nest=2, max_depth=3)
    from pyspark.ml.functions import vector_to_array
    p = staging.staged_probabilities(big, f1).join(small.transform(f1).select("rid", F.col("y").alias("_y"), vector_to_array("probability").alias("q")), "rid")
    assert p.agg(F.max(F.abs(F.get("p", F.lit(1)) - F.get("q", F.col("_y"))))).first()[0] < 1e-12


def test_errors(spark):
    rows = spark.createDataFrame([(0, [0], 1)], "k int, _lf array<int>, y int")
    values = spark.createDataFrame([(0, 0, 0, [0.5])], "step int, tree int, leaf int, value array<double>")
    with pytest.raises(ValueError):
        staging.fold_leaves(rows, values, "logit")
    with pytest.raises(ValueError):
        staging.fold_leaves(rows, values, "other")
    assert staging.fold_leaves(rows, values, "logit", include_last=True, history=True).first()["p"] == [pytest.approx(1 / (1 + 2.718281828459045**-1))]


def test_leaf_boxes_find_the_leaves_of_the_trees(spark):
    """On rows with missing cells and cells on a threshold; the fold of a model uses no leaf array."""
    f1 = fx.labelled(spark, SF_TINY).dropDuplicates(["rid"])
    model = staging.fit_forest(f1.where("flip = 0").limit(400), fx.FEATURES, "y", nest=9, max_depth=6)
    before, boxes = staging.leaf_boxes(model)
    cells = [F.when(F.rand(5 + k) < 0.2, F.lit(None)).when(F.rand(9 + k) < 0.3, F.lit(float(boxes.edges[k][0]))).otherwise(F.col(c)).alias(c) for k, c in enumerate(fx.FEATURES)]
    rows = f1.select("rid", "y", *cells).localCheckpoint()
    given = staging.with_leaves(model, rows).select(*fx.FEATURES, "_lf").toPandas()
    found = boxes.leaves([given[c].to_numpy(dtype=float) for c in fx.FEATURES])
    assert before == [] and (found == [list(v) for v in given["_lf"]]).all() and len(set(map(tuple, found))) > 5
    folded = staging.staged_dynamics(model, rows)
    assert "UDF(_features" not in folded._jdf.queryExecution().toString()
    want = staging.fold_leaves(staging.with_leaves(model, rows), staging.leaf_values(model), "mean")
    assert folded.exceptAll(want).count() == 0 and folded.count() == want.count()


def test_deep_trees_keep_the_leaf_arrays(spark, monkeypatch):
    monkeypatch.setattr(staging, "LEAF_BITS", 4)
    rows = spark.createDataFrame([(float(i), int(i * 7919 % 13 > 5)) for i in range(600)], "x double, y int")
    model = staging.fit_forest(rows, ["x"], "y", nest=3, max_depth=9)
    assert staging.leaf_boxes(model) is None
    assert staging.staged_dynamics(model, rows).count() == 600


def test_epochs_read_the_rows_once(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    (fx.labelled(spark, SF_TINY).dropDuplicates(["rid"]).write.parquet(f"{tmp_path}/rows"))
    rows = spark.read.parquet(f"{tmp_path}/rows")
    train = rows.where("flip = 0 AND crc32(rid) % 5 = 0")
    long = staging.epoch_refit_history(train, rows, fx.FEATURES, "y", epochs=(1, 3))
    assert long._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert long.columns == ["rid", "y", "checkpoint", "p"] and long.count() == 2 * rows.count()
    for i, e in ((1, 1), (2, 3)):
        lr = LogisticRegression(featuresCol="_features", labelCol="y", maxIter=e)
        one = Pipeline(stages=[staging._assembler(fx.FEATURES), lr]).fit(train).transform(rows)
        want = one.select("rid", F.get(vector_to_array("probability"), F.col("y")).alias("q")).join(long.where(F.col("checkpoint") == i), "rid")
        assert want.count() == rows.count() and want.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
