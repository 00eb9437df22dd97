import glob

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rowsift.operators import boosting
from rowsift.operators import distance as dst
from rowsift.operators import evaluate as ev
from rowsift.operators import quality as qm
from rowsift.operators.boosting import fit_boosted
from rowsift.plans import q_stream
from rowsift.session import checkpoint_root


def test_mmd_square_of_a_large_count(spark):
    rows = spark.createDataFrame([([0.0],), ([1.0],)], "x array<double>")
    syn = rows.withColumn("code", F.lit(0))
    names = F.array(F.struct(F.lit("a").alias("source"), F.lit(50_000).alias("n"), F.lit(0).alias("code")))
    got = qm._mmd_by_source(rows, syn, names, 2, 1.0).first()["score"]
    k = 2 + 2 * np.exp(-1.0)
    assert got == pytest.approx(k / 4 - 2 * k / (2 * 50_000) + k / 50_000 ** 2)


def test_mmd_blocks_agree(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(50, 3)) + 1
    df = [spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>") for x in (a, b)]
    kernel = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1)).mean()
    want = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    for block in (7, 1024):
        assert qm.mmd_rbf(*df, "x", block=block).first()["score"] == pytest.approx(want)


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_kernel_is_exact(shift):
    import pandas as pd
    rng = np.random.default_rng(1)
    r = rng.integers(0, 3, size=(900, 4)).astype(float) / 7 + shift  # copies, equal distances, little left of the norms
    q = np.concatenate([r[:40], rng.normal(size=(20, 4)) + shift])
    qid, rid = np.arange(len(q)), np.arange(len(r))
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    d[qid[:, None] == rid[None]] = np.inf
    frames = pd.DataFrame({"_qid": qid, "_qv": list(q)}), pd.DataFrame({"_rid": rid, "_rv": list(r), "_rad": np.full(len(r), 0.3)})
    got = dst._block_kernel("knn", 3, True)(*frames)
    for i in qid:
        want = sorted(zip(d[i], rid))[:3]
        assert [(x, n) for x, n in zip(got[got._qid == i]["d"], got[got._qid == i]["_rid"])] == [(pytest.approx(x, abs=1e-9), n) for x, n in want]
    counted = dst._block_kernel("range", 0, False)(*frames).set_index("_qid")["d"]
    whole = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    assert counted.tolist() == (whole < 0.3).sum(axis=1).tolist()


def test_vectors_are_sent_to_few_blocks(spark):
    v = spark.range(6000).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("x"))
    idx = dst.PivotIndex(v, "id", "x", n_pivots=1)
    assert idx.subs == [1]
    nn = {r["id"]: r["d"] for r in dst.knn(v, None, 1, "id", "nb", "x", exclude_self=True, index=idx).collect()}
    assert len(nn) == 6000 and set(nn.values()) == {1.0}


def test_fourier_features_match_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 2)), rng.normal(size=(50, 2)) + 0.5
    dfs = [spark.createDataFrame(x.tolist(), "p double, q double") for x in (a, b)]
    got = qm.mmd_rbf_rff(*dfs, ["p", "q"], n_features=16, seed=4).first()["score"]
    g = np.random.default_rng(4)
    w, c = g.normal(0, np.sqrt(2.0), size=(16, 2)), g.uniform(0, 2 * np.pi, size=16)
    gap = np.cos(a @ w.T + c).mean(0) - np.cos(b @ w.T + c).mean(0)
    assert got == pytest.approx((gap ** 2).sum() * 2 / 16)


def test_counted_rows_fit_the_same_trees(spark):
    rows = [(float(i % 7), float(i * i % 5), float((i % 7 > 3) ^ (i % 11 == 0))) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(2)
    gbt = GBTClassifier(featuresCol="f", labelCol="y", maxIter=6, maxDepth=3, maxBins=8, seed=1)
    whole = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f"), gbt]).fit(df)
    counted = fit_boosted(df, ["a", "b"], "y", gbt, "f", plain_rows=10)
    assert len(counted.stages) == 3  # binned and counted
    score = lambda m: sorted((r["a"], r["b"], round(r["probability"][1], 9)) for r in m.transform(df).select("a", "b", "probability").distinct().collect())
    assert score(whole) == score(counted)


def test_counted_rows_need_whole_features(spark):
    df = spark.createDataFrame([(float(i % 7) if i else None, float(i % 2)) for i in range(50)], "a double, y double")
    with pytest.raises(Exception, match="MUST NOT be NaN or Infinity"):
        fit_boosted(df, ["a"], "y", GBTClassifier(featuresCol="f", labelCol="y", maxIter=2, maxBins=8), "f", plain_rows=10)


def test_landed_files_are_bounded(spark, tmp_path, monkeypatch):
    (spark.range(60).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                            F.lit(10.5).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
     .write.parquet(f"{tmp_path}/orders.parquet"))
    spark.range(5).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    folder, files = q_stream._landing(spark, str(tmp_path))
    assert files == 1
    monkeypatch.setattr(q_stream, "FILE_BYTES", 1000)
    folder, files = q_stream._landing(spark, str(tmp_path))
    assert files == 4  # 20 completions of 1,390 bytes in eight arrivals
    assert spark.read.parquet(folder).count() == 20


def test_near_pairs_hold_every_tie():
    """Far from the origin, with copies, unlike sizes and a reference that is no number; runs of any length."""
    import pandas as pd
    rng = np.random.default_rng(7)
    r = rng.normal(size=(2000, 6))
    r[500:560] = r[0]  # copies
    r = r + np.array([0, 0, 0, 0, 0, 3e3])
    q = np.concatenate([r[:50], rng.normal(size=(30, 6)) * 1e-3 + r[7]])
    bad = r.copy()
    bad[1] = np.nan
    for refs, k in ((r, 5), (bad, 5), (r[:3], 5)):
        got = dst._block_kernel("knn", k, True)(pd.DataFrame({"_qid": np.arange(len(q)), "_qv": list(q)}),
                                                pd.DataFrame({"_rid": np.arange(len(refs)), "_rv": list(refs)}))
        d = np.sqrt(((q[:, None] - refs[None]) ** 2).sum(-1))
        for i in range(len(q)):
            want = sorted((x, n) for n, x in enumerate(d[i]) if n != i and np.isfinite(x))[:k]
            mine = got[got._qid == i]
            assert [(n, pytest.approx(x)) for x, n in want] == list(zip(mine["_rid"], mine["d"]))


def test_odd_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(100, None), (101, [1.0]), (102, [float("nan"), 0.0])], "id long, x array<double>")
    idx = dst.PivotIndex(rows.where("id < 40"), "id", "x", n_pivots=3)
    got = {r["id"]: (r["nb"], r["d"]) for r in dst.knn(rows, None, 1, "id", "nb", "x", exclude_self=True, index=idx).collect()}
    assert got == {i: (i - 1 if i else 1, 1.0) for i in range(40)}
    near = dst._nearest_pivot([[0.0, 0.0], [3.0, 4.0]])(rows.select("x").toPandas()["x"])
    assert near["_cell"].isna().sum() == 3 and near["_pdist"].isna().sum() == 3 and near["_cell"][0] == 0 and near["_cell"][5] == 1


def _planted_orders(spark, folder, n):
    (spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                           F.lit(10.5).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
     .write.parquet(f"{folder}/orders.parquet"))
    spark.range(5).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).write.parquet(f"{folder}/documents.parquet")


def _most_landed(monkeypatch):
    """Rows that lay landed at once, a number for each landing."""
    seen, land = [], q_stream._land

    def counted(rows, folder, files):
        land(rows, folder, files)
        seen.append(rows.sparkSession.read.parquet(folder).count())

    monkeypatch.setattr(q_stream, "_land", counted)
    monkeypatch.setattr(q_stream, "FILE_BYTES", 1000)
    return seen


def test_curation_lands_in_rounds(spark, tmp_path, monkeypatch):
    _planted_orders(spark, tmp_path, 120)
    keys = ["source", "iter", "choice", "frag_pos", "o_orderkey"]
    whole = q_stream.st1_stream_curation(spark, str(tmp_path)).select(keys).collect()
    seen = _most_landed(monkeypatch)
    got = q_stream.st1_stream_curation(spark, str(tmp_path)).select(keys).collect()
    assert sorted(got) == sorted(whole) and len(got) > 20
    assert len(seen) > 5 and sum(seen) == 40 and max(seen) <= 20  # 40 completions; before, all of them lay landed


def test_scoring_lands_in_rounds(spark, tmp_path, monkeypatch):
    _planted_orders(spark, tmp_path, 120)
    whole = q_stream.st1_stream_scored(spark, str(tmp_path)).collect()
    seen = _most_landed(monkeypatch)
    got = q_stream.st1_stream_scored(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(whole) and len(got) > 20
    assert len(seen) > 5 and sum(seen) == 40 and max(seen) <= 20


def test_quota_lands_in_rounds(spark, tmp_path, monkeypatch):
    _planted_orders(spark, tmp_path, 120)
    whole = q_stream.st2_stream_quota(spark, str(tmp_path)).collect()
    seen = _most_landed(monkeypatch)
    before = set(glob.glob(f"{checkpoint_root(spark)}/quota-batch-*"))
    got = q_stream.st2_stream_quota(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(whole) and sum(r["n_accepted"] for r in got) > 20
    assert len(seen) > 5 and sum(seen) == 40 and max(seen) <= 20
    assert set(glob.glob(f"{checkpoint_root(spark)}/quota-batch-*")) == before  # an epoch's rows go when its state is written


def _two_sources(spark, n=3000):
    rows = [("s" if i % 2 else "r", float(i % 7), float(i * i % 5), int((i % 7 > 3) ^ (i % 11 == 0))) for i in range(n)]
    return spark.createDataFrame(rows, "source string, a double, b double, y int").repartition(2)


def _small_clfs():
    return {"rf": RandomForestClassifier(featuresCol="_f", labelCol="_label", numTrees=12, seed=3),
            "dt": DecisionTreeClassifier(featuresCol="_f", labelCol="_label", seed=3),
            "lr": LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=20)}


def test_large_sources_score_as_small_ones(spark):
    df = _two_sources(spark)
    test = df.where("b < 3").drop("source")
    got, want = ({(r["source"], r["clf"]): r for r in ev.downstream(df, test, ["a", "b"], "y", _small_clfs(), plain_rows=k).collect()} for k in (10, 10_000))
    assert got.keys() == want.keys() and len(got) == 6
    for key, w in want.items():
        near = 0.02 if key[1] == "rf" else 1e-9  # a forest's draws differ
        assert got[key]["n"] == w["n"] == test.count()
        assert [got[key][c] for c in ("accuracy", "f1", "auc")] == [pytest.approx(w[c], abs=near) for c in ("accuracy", "f1", "auc")]


def test_trees_read_and_score_combinations(spark, monkeypatch):
    df = _two_sources(spark)
    found = ev.fit_predict_large(df, df, ["a", "b"], "y", _small_clfs())
    for c in ("rf", "dt"):
        rows = found[c].collect()
        assert len(rows) <= 7 * 5 * 2 and sum(r["n"] for r in rows) == 3000
    assert found["lr"].count() == 3000
    monkeypatch.setattr(ev, "DRAWN_ROWS", 10)
    assert ev.fit_predict_large(df, df, ["a", "b"], "y", _small_clfs())["rf"].count() == 3000  # hardly fewer combinations: every row


def test_a_forest_draws_every_row(spark):
    counted = spark.createDataFrame([(0.0, 0.0, 900.0), (1.0, 1.0, 4.0), (2.0, 1.0, 1.0)], "_bin_0 double, _label double, _weight double")
    rf = RandomForestClassifier(featuresCol="_f", labelCol="_label", numTrees=200, seed=5)
    drawn = boosting._drawn(counted, ["_bin_0"], rf)
    times = {r["_bin_0"]: np.array([r[f"_drawn_{k}"] for k in range(200)]) for r in drawn.collect()}
    for place, n in ((0.0, 900), (1.0, 4), (2.0, 1)):  # Poisson: mean and variance are the number of rows
        assert times[place].mean() == pytest.approx(n, abs=5 * np.sqrt(n / 200)) and times[place].var() == pytest.approx(n, rel=0.5)
    again = {r["_bin_0"]: r["_drawn_7"] for r in boosting._drawn(counted.repartition(3), ["_bin_0"], rf).collect()}
    assert again == {k: v[7] for k, v in times.items()}
    m = boosting.fit_counted(counted, rf, "_f")
    assert len(m.stages[-1].trees) == 200 and m.stages[-1].numClasses == 2
    got = {r["_bin_0"]: r["prediction"] for r in m.transform(counted).collect()}
    assert got[0.0] == 0.0 and got[1.0] == 1.0
