"""Embedding whitening by a polarisation covariance.

1. Vectors become integers (``quantise``), so that every sum below is exact.
2. One pass sums each dimension. With m = floor(sum / n), z = x - m is centred up to the fraction
   r = sum - n * m, and n * x - sum = n * z - r.
3. One pass aggregates the squares of z_i for every dimension and of z_i + z_j for every pair. The
   squared centred values follow exactly: the sum of (n * x - sum)^2 is n^2 * sum(z^2) - n * r^2, and
   likewise for a pair with r_i + r_j. The variance of a pair's sum less both variances is twice
   the cross-covariance (polarisation).
4. The exact covariance, one number per pair, is assembled on the driver for ``eigh``; rows are
   projected where they lie, and a last pass measures the covariance of what was written.

Scale: four narrow passes; a task emits one row per dimension or pair, whatever its rows, so nothing
grows with the table but the number of tasks (partial sums are merged by a shuffle on the pair). The
driver holds dimensions^2 numbers. Sums of squares are Python integers (limbs of 21 bits where 64
bits could overflow), shuffled as decimals of 38 digits.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part; of
different lengths only vectors of the most frequent one do (the longer, if tied); values are clamped
to +-2^43 before rounding down; rows with a null or repeated id take part; with fewer than two
distinct vectors, or in directions without variance, there is no component and no row; an empty
table gives no rows; other columns are ignored; ``deviation`` is null beyond 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
CLAMP = 1 << 43
LIMB = 21
CELLS = 1 << 19  # numbers of one block of pair sums


@dataclass(frozen=True)
class Whitener:
    """``n`` vectors with exact per-dimension ``sums`` and ``covariance`` (numerators over n^3); ``directions``
    (dimensions x components) are unit eigenvectors, ``values`` their eigenvalues, ``trace`` the whole variance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, e (array of doubles): the vectors that take part."""
    at = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].cast("array<double>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    at = at.where(F.col("e").isNotNull() & (F.size("e") > 0) & ~F.coalesce(F.exists("e", bad), F.lit(False)))
    sizes = at.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return at.where(F.size("e") == (sizes["d"] if sizes else 0))


def quantise(flat: np.ndarray) -> np.ndarray:
    """floor(1024 * value) + 100000."""
    return np.floor(np.clip(flat, -CLAMP, CLAMP) * SCALE).astype(np.int64) + SHIFT


def _matrices(batches, d: int):
    """(batch, integer matrix) of at most CELLS / d rows."""
    for batch in batches:
        step = max(1, CELLS // d)
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part, quantise(part.column("e").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def square_sums(t: np.ndarray) -> list[int]:
    """Exact sum of squares of each column of an integer matrix of at most CELLS rows, entries below 2^62."""
    top = int(np.abs(t).max(initial=0))
    if top * top * len(t) < 1 << 62:
        return np.einsum("ij,ij->j", t, t).tolist()
    mask = (1 << LIMB) - 1
    limbs = [t & mask, (t >> LIMB) & mask, t >> (2 * LIMB)]  # the last one has the sign
    out = [0] * t.shape[1]
    for a, x in enumerate(limbs):
        for b, y in enumerate(limbs):
            for j, v in enumerate(np.einsum("ij,ij->j", x, y).tolist()):
                out[j] += v << (LIMB * (a + b))
    return out


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def _sum_pass(d: int):
    def run(batches):
        n, total = 0, [0] * d
        for _, x in _matrices(batches, d):
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [s + (h << 32) + v for s, h, v in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(total)], names=["i", "n", "s"])
    return run


def _square_pass(d: int, floors: np.ndarray):
    def run(batches):
        total = {i: [0] * (d - i) for i in range(d)}
        seen = False
        for _, x in _matrices(batches, d):
            z, seen = x - floors, True
            for i in range(d):
                pair = z[:, i:] + z[:, i:i + 1]
                pair[:, 0] = z[:, i]  # the dimension alone
                total[i] = [a + b for a, b in zip(total[i], square_sums(pair), strict=True)]
        for i in range(d if seen else 0):
            yield pa.RecordBatch.from_arrays([pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), _decimals(total[i])], names=["i", "j", "q"])
    return run


def exact_moments(at: DataFrame) -> tuple[int, list[int], dict[tuple[int, int], int]] | None:
    """(n, sums S, squares Q) over usable vectors: Q[i, i] is the sum of (n * x_i - S_i)^2, Q[i, j] that of
    (n * x_i - S_i + n * x_j - S_j)^2; all exact. None without a vector."""
    first = at.select(F.size("e").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    e = at.select("e")
    rows = e.mapInArrow(_sum_pass(d), "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # d rows
    n, sums = rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]
    floors = np.array([s // n for s in sums], np.int64)
    rests = [s % n for s in sums]
    pairs = e.mapInArrow(_square_pass(d, floors), "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()  # d * (d + 1) / 2 rows
    shift = lambda i, j: rests[i] if i == j else rests[i] + rests[j]
    return n, sums, {(r["i"], r["j"]): n * n * int(r["q"]) - n * shift(r["i"], r["j"]) ** 2 for r in pairs}


def covariance(n: int, squares: dict[tuple[int, int], int], d: int) -> np.ndarray:
    """The covariance matrix (divisor n) from exact squares, each entry rounded once."""
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            out[i, j] = out[j, i] = float(Fraction(twice, 2 * n**3))
    return out


def fit(at: DataFrame, components: int = 8) -> Whitener | None:
    """The whitener of usable vectors, from their polarisation covariance; None without one with variance."""
    moments = exact_moments(at)
    if moments is None:
        return None
    n, sums, squares = moments
    v = covariance(n, squares, len(sums))
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0) * len(sums) * np.finfo(float).eps][:components]
    if not len(order):
        return None
    directions = vectors[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Whitener(n, tuple(sums), directions * signs, values[order], float(np.trace(v)))


def _project(w: Whitener, d: int):
    floors, rests = w.floors, w.rests
    axes = w.directions / np.sqrt(w.values)

    def deviations(z: np.ndarray) -> pa.Array:
        top = int(np.abs(z).max(initial=0)) + 1
        if d * (w.n * top) ** 2 < 1 << 62:
            y = z * w.n - rests
            return _decimals(np.einsum("ij,ij->i", y, y).tolist())
        return _decimals([sum((w.n * a - b) ** 2 for a, b in zip(row, rests.tolist(), strict=True)) for row in z.tolist()])

    def run(batches):
        for batch, x in _matrices(batches, d):
            z = x - floors
            white = (z - rests / w.n) @ axes
            values = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), axes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviations(z), values], names=["vec_id", "deviation", "whitened"])
    return run


def transform(at: DataFrame, w: Whitener) -> DataFrame:
    """vec_id, deviation (decimal), whitened (array, one value per component) of usable vectors."""
    schema = f"vec_id {at.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return at.mapInArrow(_project(w, len(w.sums)), schema)


def _moment_pass(k: int):
    def run(batches):
        n, s, q = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            m = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n, s, q = n + len(m), s + m.sum(axis=0), q + m.T @ m
        if n:
            rows = pa.array(range(k), pa.int32())
            yield pa.RecordBatch.from_arrays([rows, pa.array([n] * k, pa.int64()), pa.array(s), pa.array(q.tolist(), pa.list_(pa.float64()))], names=["i", "n", "s", "q"])
    return run


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured over the rows
    (the means are 0 but for rounding, so the products need no further centring)."""
    cells = white.select("whitened").mapInArrow(_moment_pass(k), "i int, n bigint, s double, q array<double>")
    rows = (cells.select("i", "n", "s", F.posexplode("q").alias("j", "q")).groupBy("i", "j")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect())  # k * k rows
    mean = {r["i"]: r["s"] / r["n"] for r in rows}
    return max(abs(r["q"] / r["n"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row per usable vector and component."""
    out = "vec_id {}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    at = usable(vectors, id_col, vec_col)
    w = fit(at, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], out.format(at.schema["vec_id"].dataType.simpleString()))
    white = cut_lineage(transform(at, w), "whitened")
    shares = F.array(*[F.lit(float(v) / w.trace) for v in w.values])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(identity_error(white, len(w.values))).alias("identity_error"))
