"""Whitening against numpy on the whole table, exact sums against Python integers, and edge cases."""
import math
from fractions import Fraction

import numpy as np
import pytest

from rowsift.llm import queries
from rowsift.llm import whitening as wh
from tests.conftest import SF_TINY

SCHEMA = "vec_id long, embedding array<double>, n string, whitened int"


def ints(rows):
    return [[math.floor(1024 * c) + 100000 for c in v] for v in rows]


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF_TINY}/embeddings.parquet").toPandas()
    x = np.array(ints([[float(c) for c in v] for v in table["embedding"]]), dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in y.T @ y])
    values, vectors = np.linalg.eigh(v)
    got = queries.QUERIES["op12_whitening"](spark, SF_TINY).toPandas()
    assert len(got) == 8 * n and dict(got.dtypes)["deviation"] == "int64"
    dev = dict(zip(table["vec_id"], (y * y).sum(axis=1)))
    assert all(dev[i] == d for i, d in zip(got["vec_id"], got["deviation"]))
    for k in range(1, 9):
        one = got[got["component"] == k].set_index("vec_id")["whitened"]
        want = (y / n).astype(float) @ vectors[:, -k] / np.sqrt(values[-k])
        have = one.loc[table["vec_id"]].to_numpy()
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-8
        assert abs(got[got["component"] == k]["explained"].iloc[0] / (values[-k] / np.trace(v)) - 1) < 1e-9
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize("size", [1.0, 3e5, 7e12])
def test_moments_are_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(k % 7, (rng.normal(size=3) * size + size).tolist(), "x", 1) for k in range(50)]
    n, sums, squares = wh.exact_moments(wh.usable(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    x = ints([np.clip(r[1], -wh.CLAMP, wh.CLAMP).tolist() for r in rows])
    s = [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    assert n == 50 and sums == s
    for i in range(3):
        for j in range(i, 3):
            assert squares[i, j] == sum((r[i] if i == j else r[i] + r[j]) ** 2 for r in y)


def test_limbs():
    t = np.array([[2**55 - 1, -(2**55)], [-12345678901234, 3]])
    assert wh.square_sums(t) == [(2**55 - 1) ** 2 + 12345678901234**2, 2**110 + 9]


def test_edges(spark):
    ok = [(k, [float(k), float(k * k % 5)], None, None) for k in range(6)]
    bad = [(10, None, None, 1), (11, [], None, 1), (12, [float("nan"), 1.0], None, 1), (13, [float("inf"), 1.0], None, 1), (14, [None, 1.0], None, 1), (15, [1.0], None, 1)]
    more = [(None, [2.5, 0.5], "z", 2), (3, [3.0, 4.0], "z", 2), (3, [3.0, 4.0], "z", 2)]
    got = wh.whiten(spark.createDataFrame(ok + bad + more, SCHEMA)).toPandas()
    assert sorted(got["component"].unique()) == [1, 2] and (got["n"] == 9).all() and len(got) == 18 and got["identity_error"].iloc[0] < 1e-9
    line = [(k, [float(k), 7.0], None, None) for k in range(4)]  # no variance in the second direction
    assert set(wh.whiten(spark.createDataFrame(line, SCHEMA)).toPandas()["component"]) == {1}
    for rows in ([], bad[:5], [(1, [1.0, 2.0], None, None)] * 3):
        empty = wh.whiten(spark.createDataFrame(rows, SCHEMA))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
