import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsift.operators import distance as dst
from rowsift.operators import evaluate as ev
from rowsift.operators import oversample as ov
from rowsift.operators import quality as qm
from rowsift.sources import fixtures as fx
from tests.conftest import SF_TINY


def _vectors(spark):
    return fx.vectors(spark, SF_TINY)


def test_knn_ties_go_to_smaller_ids(spark):
    pts = [(i, [float(i % 4), float(i // 4 % 3)]) for i in range(60)]
    v = spark.createDataFrame(pts, "vec_id long, embedding array<double>")
    got = {}
    for pivots in (1, 5):
        nn = dst.knn(v, v.withColumnRenamed("vec_id", "nb"), 3, "vec_id", "nb", "embedding", exclude_self=True, n_pivots=pivots)
        got[pivots] = sorted((r["vec_id"], r["rank"], r["nb"]) for r in nn.collect())
    want = []
    for i, a in pts:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in pts if j != i)[:3]
        want += [(i, rank, j) for rank, (_, j) in enumerate(near, 1)]
    assert got[1] == got[5] == want


def test_knn_matches_brute_force(spark):
    v = _vectors(spark)
    rows = v.collect()
    ids = np.array([r["vec_id"] for r in rows])
    X = np.array([r["embedding"] for r in rows])
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    nn = dst.knn(v, v.withColumnRenamed("vec_id", "nb"), 3, "vec_id", "nb", "embedding", exclude_self=True, n_pivots=8)
    got = {}
    for r in nn.collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["d"]))
    for i, q in enumerate(ids[:50]):
        want = np.sort(D[i])[:3]
        assert [d for _, d in sorted(got[q])] == pytest.approx(list(want), rel=1e-9)


def test_prdc_of_table_with_itself(spark):
    v = _vectors(spark)
    out = {r["metric"]: r["score"] for r in qm.prdc(v, v, "vec_id", "embedding", k=5, n_pivots=8).collect()}
    assert out["precision"] == pytest.approx(1.0) and out["recall"] == pytest.approx(1.0)
    assert out["coverage"] == pytest.approx(1.0)


def test_ks_and_wasserstein_brute_force(spark):
    a = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 5, 7]], "x double")
    b = spark.createDataFrame([(float(x),) for x in [2, 3, 3, 9]], "x double")
    ks = qm.kolmogorov_smirnov(a, b, ["x"]).first()["statistic"]
    w = qm.wasserstein_1d(a, b, ["x"]).first()["distance"]
    grid = np.array([1, 2, 3, 5, 7, 9], dtype=float)
    fa = np.array([np.mean(np.array([1, 2, 2, 5, 7]) <= g) for g in grid])
    fb = np.array([np.mean(np.array([2, 3, 3, 9]) <= g) for g in grid])
    assert ks == pytest.approx(np.max(np.abs(fa - fb)))
    assert w == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))
    same = qm.jensen_shannon(qm.histograms(a, a, ["x"])).first()["divergence"]
    assert same == pytest.approx(0.0, abs=1e-12)


def test_auc_with_ties_brute_force(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.9, 0.8, 0.3, 0.3, 0.1, 0.5, 0.6]
    df = spark.createDataFrame([("a", "m", yy, ss) for yy, ss in zip(y, s)], "source string, clf string, y int, score double")
    auc = ev.roc_auc(df).first()["auc"]
    pos = [ss for yy, ss in zip(y, s) if yy == 1]
    neg = [ss for yy, ss in zip(y, s) if yy == 0]
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])
    assert auc == pytest.approx(want)


def test_smote_on_segments_and_counts(spark):
    v = _vectors(spark).where(F.col("label") < 3)
    out = ov.smote(v, "vec_id", "embedding", "label", n=80, k=4, seed=1, n_pivots=4)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert set(counts.values()) == {80}
    # every synthetic point lies inside the bounding box of its class (on a segment of two members)
    for lab in range(3):
        orig = np.array([r["embedding"] for r in v.where(F.col("label") == lab).collect()])
        syn = np.array([r["embedding"] for r in out.where((F.col("label") == lab) & (F.col("is_synthetic") == 1)).collect()])
        assert (syn >= orig.min(0) - 1e-9).all() and (syn <= orig.max(0) + 1e-9).all()


def test_chi_squared_counts_rows_in_empty_real_bins(spark):
    real = spark.createDataFrame([(float(v),) for v in [0] * 50 + [10] * 50], "x double")
    syn = spark.createDataFrame([(float(v),) for v in [0] * 30 + [10] * 30 + [5] * 40], "x double")
    got = qm.chi_squared(qm.histograms(real, syn, ["x"])).collect()
    assert [(r["statistic"], r["dof"], r["outside"]) for r in got] == [((70 - 50) ** 2 / 50 + (30 - 50) ** 2 / 50, 1, 40)]
    same = qm.chi_squared(qm.histograms(real, real, ["x"])).first()
    assert (same["statistic"], same["dof"], same["outside"]) == (0.0, 1, 0)


def test_report_errors_are_rows(spark):
    ref = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(20)], "id long, x array<double>")
    rows = [(i, [float(i) / 2, 1.0], "ok") for i in range(8)] + [(i, [1.0, float("nan")], "odd") for i in range(8)] + [(1, [1.0, 2.0], "few")]
    rows += [(i, [1.0], "short") for i in range(8)] + [(i, None, "none") for i in range(8)]
    src = spark.createDataFrame(rows, "id long, x array<double>, source string")
    got = qm.quality_report(src, ref, "x", "id", metrics=("jsd", "nearest_distance", "other"), n_pivots=2).collect()
    scored = {(r["metric"], r["source"]): r["score"] for r in got if r["error"] is None}
    assert set(scored) == {("jsd", "ok"), ("nearest_distance", "ok")} and all(v is not None for v in scored.values())
    errors = {(r["metric"], r["source"]) for r in got if r["error"]}
    assert errors == {(m, s) for m in ("jsd", "nearest_distance", "other") for s in ("odd", "few", "short", "none")} | {("other", "ok")}
    broken = qm.quality_report(src, ref.limit(3), "x", "id", n_pivots=2)
    assert broken.where("error IS NULL").count() == 0 and broken.count() == 35
