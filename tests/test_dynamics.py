import math

import pytest
from pyspark.sql import functions as F

from rowsift.operators import dynamics as dyn


def _wide(spark, rows):
    return spark.createDataFrame(rows, "source string, rid string, y int, p array<double>")


def test_wide_metrics_match_definitions(spark):
    hist = [0.1, 0.4, 0.9, 0.6]
    out = dyn.wide_dynamics(_wide(spark, [("s", "a", 1, hist)])).first()
    c = sum(hist) / 4
    assert out["confidence"] == pytest.approx(c)
    assert out["aleatoric"] == pytest.approx(sum(p * (1 - p) for p in hist) / 4)
    var = sum((p - c) ** 2 for p in hist) / 4
    assert out["variability"] == pytest.approx(math.sqrt(var))
    assert out["correctness"] == pytest.approx(0.5)  # strict > 0.5
    assert out["entropy"] == pytest.approx(-sum(p * math.log(p + 1e-12) for p in hist))
    # algebra: aleatoric = c(1 - c) - variability^2
    assert out["aleatoric"] == pytest.approx(c * (1 - c) - var)


def test_long_equals_wide(spark):
    rows = [("s", f"r{i}", i % 2, [((i * 7 + j * 3) % 10) / 10 + 0.05 for j in range(5)]) for i in range(20)]
    w = dyn.wide_dynamics(_wide(spark, rows))
    long = dyn.explode_history(_wide(spark, rows))
    lg = dyn.row_dynamics(long, ["source", "rid"], carry=["y"])
    j = w.join(lg.select("rid", *[F.col(m).alias("l_" + m) for m in dyn.METRIC_COLUMNS]), "rid")
    for m in dyn.METRIC_COLUMNS:
        assert j.agg(F.max(F.abs(F.col(m) - F.col("l_" + m)))).first()[0] < 1e-12


def test_groups_partition_and_thresholds(spark):
    rows = [("s", "hard", 0, [0.05] * 4), ("s", "easy", 1, [0.95] * 4), ("s", "mid", 1, [0.5] * 4),
            ("s", "nan", 1, [float("nan")] * 4)]
    g = dyn.assign_groups(dyn.wide_dynamics(_wide(spark, rows)), "aleatoric", 0.2, 0.2)
    got = {r["rid"]: r["grp"] for r in g.collect()}
    assert got == {"hard": "hard", "easy": "easy", "mid": "ambig", "nan": "ambig"}
    with pytest.raises(ValueError):
        dyn.assign_groups(dyn.wide_dynamics(_wide(spark, rows)), "aleatoric", 0.5, 0.2)
    with pytest.raises(ValueError):
        dyn.assign_groups(dyn.wide_dynamics(_wide(spark, rows)), "nonsense", 0.2, 0.2)


def test_raising_ythresh_never_grows_ambig(spark):
    rows = [("s", f"r{i}", 1, [i / 40 + 0.01] * 3) for i in range(40)]
    d = dyn.wide_dynamics(_wide(spark, rows))
    sizes = [dyn.assign_groups(d, "aleatoric", y, 0.25).where("grp = 'ambig'").count() for y in (0.1, 0.2, 0.3, 0.4)]
    assert sizes == sorted(sizes, reverse=True)


def test_mi_subtracts_table_scalar(spark):
    rows = [("s", "a", 1, [0.2, 0.4]), ("s", "b", 1, [0.7, 0.9])]
    m = {r["rid"]: r for r in dyn.add_mi(dyn.wide_dynamics(_wide(spark, rows)), ["source"]).collect()}
    big_e = -sum(c * math.log(c + 1e-12) for c in (0.3, 0.8))
    assert m["a"]["mi"] == pytest.approx(m["a"]["entropy"] - big_e)


def test_adaptive_threshold(spark):
    rows = [("s", f"r{i}", 1, [0.1 * (i + 1)] * 2) for i in range(9)]
    g = dyn.assign_groups(dyn.wide_dynamics(_wide(spark, rows)), "aleatoric", 0.2, 0)
    al = [0.1 * (i + 1) * (1 - 0.1 * (i + 1)) for i in range(9)]
    assert g.first()["xthresh"] == pytest.approx(0.75 * (max(al) - min(al)))
