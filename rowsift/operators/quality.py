"""Statistical closeness of a synthetic table to a reference table (Q0-Q10).

Column-wise metrics (Q3-Q6, Q8, Q10) are grouped aggregates over the long
(``unpivot``) form, with range-partitioned running counts for the ordered ones
(``ordered.py``). Per-column values reach the rows by a measured broadcast
(``attach.py``), so rows never move by column. Vector metrics (Q1, Q2, Q7, Q9)
use the exact pivot-pruned neighbour search of ``distance.py`` - no cross
join, no pair of rows leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.functions.literals import const_array
from rowsift.operators import distance as dst
from rowsift.operators import sampling as smp
from rowsift.operators.attach import attach
from rowsift.operators.ordered import quantiles, quantiles_by, running
from rowsift.session import cut_lineage

EPS = 1e-10


# ------------------------------------------------------------------ long form
def to_long(df: DataFrame, cols: Sequence[str], side: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "col", "v").withColumn("side", F.lit(side))


def _both(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    return to_long(real, cols, "real").unionByName(to_long(syn, cols, "syn"))


# ------------------------------------------------------------------ Q3 / Q4 / Q6 (histograms)
def histograms(real: DataFrame, syn: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Per (col, bin): real and synthetic proportions; equal-width bins over the real range."""
    both = _both(real, syn, cols).where(F.col("v").isNotNull())
    rng = to_long(real, cols, "real").groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)),
                F.lit(bins - 1))).cast("int")
    counts = (attach(both, rng, ["col"]).where(F.col("lo").isNotNull()).withColumn("bin", b)
                  .groupBy("col", "bin").agg(F.sum((F.col("side") == "real").cast("long")).alias("n_real"),
                                             F.sum((F.col("side") == "syn").cast("long")).alias("n_syn")))
    w = Window.partitionBy("col")  # one row per (col, bin): bounded by cols * bins
    return (counts.withColumn("p", F.col("n_real") / F.sum("n_real").over(w))
                  .withColumn("q", F.col("n_syn") / F.sum("n_syn").over(w)))


def inverse_kl(hist: DataFrame, by: Sequence[str] = ("col",)) -> DataFrame:
    """Per column 1 / (1 + KL(real || syn)), smoothed; plus the mean over columns."""
    kl = hist.groupBy(*by).agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(
        F.col("p") / (F.col("q") + F.lit(EPS))))).alias("kl"))
    return kl.select(*by, (1 / (1 + F.coalesce(F.col("kl"), F.lit(0.0)))).alias("score"))


def jensen_shannon(hist: DataFrame, by: Sequence[str] = ("col",)) -> DataFrame:
    m = (F.col("p") + F.col("q")) / 2
    term = (F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / m)).otherwise(0)
            + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / m)).otherwise(0)) / 2
    js = hist.groupBy(*by).agg(F.sum(term).alias("js"))
    return js.select(*by, F.col("js").alias("divergence"), F.sqrt(F.greatest(F.col("js"), F.lit(0.0))).alias("distance"))


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: trapezoidal sum over the whole line and the term for its pole."""
    step = 0.5
    terms = sum((F.lit(math.exp(-(k * step) ** 2)) / (z * z + F.lit((k * step) ** 2)) for k in range(1, 14)), 0.5 / (z * z))
    far = 2 * step / math.pi * z * F.exp(-z * z) * terms + 2 / (1 - F.exp(2 * math.pi / step * z))
    return F.when(z < 1e-4, 1 - 2 / math.sqrt(math.pi) * z).when(z > 30, 0.0).otherwise(far)


def chi_squared_tail(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for a chi-squared X: the closed form for whole degrees of freedom, its terms summed as
    logarithms. Null without a degree of freedom."""
    h, odd = statistic.cast("double") / 2, dof % 2 == 1
    shift = F.when(odd, 0.5).otherwise(0.0)  # terms h ** (k + shift) * exp(-h) / gamma(k + shift + 1), k = 0, 1, ...
    zero = F.struct(F.lit(0.0).alias("total"), (F.when(odd, F.log(h) / 2 - math.log(math.sqrt(math.pi) / 2)).otherwise(0.0) - h).alias("log"))
    n = F.floor(dof / 2).cast("int")
    terms = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, zero, lambda a, k: F.struct((a["total"] + F.exp(a["log"])).alias("total"),
                                                           (a["log"] + F.log(h) - F.log(k + shift)).alias("log")), lambda a: a["total"])
    tail = total + F.when(odd, _erfc(F.sqrt(h))).otherwise(0.0)
    return F.when(dof > 0, F.when(h <= 0, 1.0).otherwise(F.least(tail, F.lit(1.0))))


def chi_squared(hist: DataFrame) -> DataFrame:
    """Statistic of synthetic bin counts against the real proportions, its p-value, and how many synthetic rows lie in
    bins that are empty in the real table. Such a bin is merged with the next lower one that holds real rows."""
    w = Window.partitionBy("col")
    held = F.when(F.col("p") > 0, F.col("bin"))
    e = (hist.withColumn("slot", F.coalesce(F.max(held).over(w.orderBy("bin")), F.min(held).over(w)))
             .groupBy("col", "slot").agg(F.sum("p").alias("p"), F.sum("n_syn").alias("n_syn"),
                                         F.sum(F.when(F.col("p") > 0, 0).otherwise(F.col("n_syn"))).alias("outside"))
             .withColumn("exp", F.col("p") * F.sum("n_syn").over(w)))
    s = e.where(F.col("exp") > 0).groupBy("col").agg(
        F.sum((F.col("n_syn") - F.col("exp")) ** 2 / F.col("exp")).alias("statistic"),
        (F.count("*") - 1).alias("dof"), F.sum("outside").alias("outside"))
    return s.withColumn("p_value", chi_squared_tail(F.col("statistic"), F.col("dof")))


# ------------------------------------------------------------------ ordered counts (Q5 / Q8 / Q10)
def _cdf_gap(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """col, v, gap (difference of the distribution functions at v), next_v; from integer counts."""
    both = _both(real, syn, cols).where(F.col("v").isNotNull())
    return _gaps(both.groupBy("col", "v").agg(F.sum((F.col("side") == "real").cast("long")).alias("cr"),
                                              F.sum((F.col("side") == "syn").cast("long")).alias("cs")), ["col"])


def _gaps(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    per = cut_lineage(counts, "value-counts")
    n = per.groupBy(*by).agg(F.sum("cr").alias("nr"), F.sum("cs").alias("ns"))
    at = attach(running(per, by, "v", ["cr", "cs"]), n, by)
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0))
    return at.select(*by, "v", (share("cum_cr", "nr") - share("cum_cs", "ns")).alias("gap"), "next_v")


def kolmogorov_smirnov(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column the two-sample KS statistic and 1 - statistic."""
    g = _cdf_gap(real, syn, cols)
    return g.groupBy("col").agg(F.max(F.abs("gap")).alias("statistic")).withColumn("score", 1 - F.col("statistic"))


def wasserstein_1d(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column exact 1-D Wasserstein-1: integral of |F_real - F_syn|."""
    g = _cdf_gap(real, syn, cols)
    return g.groupBy("col").agg(F.sum(F.abs("gap") * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))).alias("distance"))


def _survival(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, t, survival from rows (by, t, c, d): c leave at t, d of them by the event."""
    by = list(by)
    counts = cut_lineage(counts, "event-counts")
    total = counts.groupBy(*by).agg(F.sum("c").alias("_n"))
    at = attach(running(counts, by, "t", ["c"]), total, by)
    at_risk = F.col("_n") - F.col("cum_c") + F.col("c")
    ends = (F.col("d") > 0) & (F.col("d") >= at_risk)
    steps = at.select(*by, "t", F.when(ends | (F.col("d") <= 0), F.lit(0.0)).otherwise(F.log(1 - F.col("d") / at_risk)).alias("log"),
                      ends.cast("long").alias("ended"))
    done = running(steps, by, "t", ["log", "ended"])
    return done.select(*by, "t", F.when(F.col("cum_ended") > 0, F.lit(0.0)).otherwise(F.exp("cum_log")).alias("survival"))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ("source",)) -> DataFrame:
    """Survival curve per group: S(t) = prod_{t_i <= t} (1 - d_i / n_i)."""
    return _survival(df.groupBy(*by, F.col(time).cast("double").alias("t")).agg(
        F.count("*").alias("c"), F.coalesce(F.sum(F.col(event).cast("long")), F.lit(0)).alias("d")), by)


def km_distance(df: DataFrame, time: str, event: str, a: str, b: str, src: str = "source") -> DataFrame:
    """Mean absolute gap between the KM curves of sources ``a`` and ``b`` over the union of
    their times: both curves are evaluated on the union grid (zero counts where a source
    has no row), so each step function is defined at every grid time."""
    one = lambda s: (F.col(src) == s)
    per = df.where(F.col(src).isin(a, b)).groupBy(F.col(time).cast("double").alias("t")).agg(*[
        F.struct(F.sum(one(s).cast("long")).alias("c"), F.coalesce(F.sum(F.when(one(s), F.col(event).cast("long"))), F.lit(0)).alias("d"), F.lit(s).alias("s")).alias(k)
        for k, s in (("a", a), ("b", b))])
    grid = per.select("t", F.explode(F.array("a", "b")).alias("x")).select(F.col("x.s").alias("s"), "t", "x.c", "x.d")
    curves = _survival(grid, ["s"]).groupBy("t").agg(F.sum(F.when(F.col("s") == a, F.col("survival")).otherwise(-F.col("survival"))).alias("gap"))
    return curves.agg(F.avg(F.abs("gap")).alias("distance"))


# ------------------------------------------------------------------ Q1 PRDC
def prdc(real: DataFrame, syn: DataFrame, id_col: str, vec: str, k: int = 5,
         n_pivots: int | None = None) -> DataFrame:
    """precision, recall, density, coverage (strict < on k-NN ball radii).

    One pivot index per side, reused by the radius search, the ball joins and
    the coverage search; every count comes from one aggregate.
    """
    spark = real.sparkSession
    real, syn = real.select(id_col, vec), syn.select(id_col, vec)
    ir = dst.PivotIndex(real, id_col, vec, n_pivots=n_pivots)
    is_ = dst.PivotIndex(syn, id_col, vec, n_pivots=n_pivots)
    # read two and three times, searched for once
    r_real = cut_lineage(dst.kth_distance(real, id_col, k, vec, index=ir).withColumnRenamed("radius", "r"), "real-balls")
    r_syn = cut_lineage(dst.kth_distance(syn, id_col, k, vec, index=is_).withColumnRenamed("radius", "r"), "syn-balls")
    n, m = ir.n_rows, is_.n_rows
    inside = dst.range_counts(syn.withColumnRenamed(id_col, "_sid"), r_real, "_sid", id_col, "r", vec, index=ir)
    pr = inside.agg(F.sum((F.col("n") > 0).cast("long")).alias("a"), F.sum("n").alias("b")).first()
    covered = dst.range_counts(real.withColumnRenamed(id_col, "_rid2"), r_syn, "_rid2", id_col, "r", vec, index=is_)
    rec = (covered.agg(F.sum((F.col("n") > 0).cast("long"))).first()[0] or 0) / max(n, 1)
    nn = dst.knn(real, None, 1, id_col, "_sid", vec, index=is_)
    cov = nn.join(r_real, id_col).agg(F.sum((F.col("d") < F.col("r")).cast("long"))).first()[0] or 0
    return spark.createDataFrame([("precision", (pr["a"] or 0) / max(m, 1)), ("recall", float(rec)),
                                  ("density", (pr["b"] or 0) / max(k * m, 1)), ("coverage", cov / max(n, 1))],
                                 "metric string, score double")


# ------------------------------------------------------------------ Q9
def nearest_synthetic_distance(real: DataFrame, syn: DataFrame, id_col: str, vec: str,
                               n_pivots: int | None = None) -> DataFrame:
    """Per real row the distance to its nearest synthetic row, min-max scaled; mean of it."""
    nn = dst.knn(real, syn.withColumnRenamed(id_col, "_sid"), 1, id_col, "_sid", vec, n_pivots=n_pivots)
    st = nn.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    sc = nn.crossJoin(F.broadcast(st)).select(
        F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("s"))
    return sc.agg(F.avg("s").alias("score"))


# ------------------------------------------------------------------ Q2
ALPHAS = [i / 29 for i in range(30)]


def alpha_precision(real: DataFrame, syn: DataFrame, id_col: str, vec: str,
                    n_pivots: int | None = None, seed=42) -> DataFrame:
    """Naive alpha-precision / beta-recall on raw features plus authenticity.

    The larger table is first cut to the size of the smaller one (D10). Centre = mean real
    vector; alpha-ball radii = exact alpha-quantiles of the real distances to the centre. delta_precision_alpha = 1 - 2 * mean|P(alpha) - alpha|,
    delta_coverage_beta likewise with real rows inside synthetic balls;
    authenticity = share of synthetic rows farther from their nearest real row
    than that real row is from its own nearest real neighbour.
    """
    spark = real.sparkSession
    real, syn = (cut_lineage(x.select(id_col, vec), "matched") for x in smp.size_match(real, syn, id_col, seed))
    d = len(real.select(vec).first()[0])
    cen = real.agg(*[F.avg(F.element_at(vec, i + 1)).alias(f"c{i}") for i in range(d)]).first()
    center = const_array([float(cen[f"c{i}"]) for i in range(d)])
    scen = syn.agg(*[F.avg(F.element_at(vec, i + 1)).alias(f"c{i}") for i in range(d)]).first()
    s_center = const_array([float(scen[f"c{i}"]) for i in range(d)])
    rd = real.select(dst.dist(F.col(vec), center).alias("r"))
    sd = syn.select(dst.dist(F.col(vec), center).alias("r"))
    radii = quantiles(rd, "r", ALPHAS)
    prec = sd.agg(*[F.avg((F.col("r") <= F.lit(float(q))).cast("double")).alias(f"a{i}") for i, q in enumerate(radii)]).first()
    curve = [prec[f"a{i}"] for i in range(len(ALPHAS))]
    srd = syn.select(dst.dist(F.col(vec), s_center).alias("r"))
    sradii = quantiles(srd, "r", ALPHAS)
    rrd = real.select(dst.dist(F.col(vec), s_center).alias("r"))
    cov = rrd.agg(*[F.avg((F.col("r") <= F.lit(float(q))).cast("double")).alias(f"b{i}") for i, q in enumerate(sradii)]).first()
    bcurve = [cov[f"b{i}"] for i in range(len(ALPHAS))]
    dpa = 1 - 2 * sum(abs(c - a) for c, a in zip(curve, ALPHAS)) / len(ALPHAS)
    dcb = 1 - 2 * sum(abs(c - a) for c, a in zip(bcurve, ALPHAS)) / len(ALPHAS)
    r1 = dst.kth_distance(real, id_col, 1, vec, n_pivots).withColumnRenamed("radius", "r1")
    nn = dst.knn(syn.withColumnRenamed(id_col, "_sid"), real, 1, "_sid", id_col, vec, n_pivots=n_pivots)
    auth = nn.join(r1, id_col).agg(F.avg((F.col("r1") < F.col("d")).cast("double"))).first()[0]
    return spark.createDataFrame([("delta_precision_alpha", float(dpa)), ("delta_coverage_beta", float(dcb)),
                                  ("authenticity", float(auth or 0.0))], "metric string, score double")


# ------------------------------------------------------------------ Q7
def mmd_linear(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact linear-kernel MMD: squared distance between the mean vectors (two aggregates)."""
    a = real.agg(*[F.avg(c).alias(c) for c in cols]).first()
    b = syn.agg(*[F.avg(c).alias(c) for c in cols]).first()
    val = sum((float(a[c]) - float(b[c])) ** 2 for c in cols)
    return real.sparkSession.createDataFrame([("mmd_linear", val)], "metric string, score double")


MMD_BLOCK = 1024  # rows of a block, and of a piece of a kernel matrix
MMD_BLOCKS = 24  # blocks grow beyond this number of them, up to MMD_LARGEST rows: each row is sent once per block
MMD_LARGEST = 8192


def mmd_rbf(real: DataFrame, syn: DataFrame, vec: str, gamma: float = 1.0, block: int = MMD_BLOCK) -> DataFrame:
    """Exact squared RBF-kernel MMD (mean over all ordered pairs, a row with itself included); null without rows on a side.

    Rows are dealt to blocks of about ``block`` rows; every unordered pair of blocks is one bounded group, which adds
    its kernel values up and gives a few numbers. No pair of rows leaves a task, but the work grows with
    the square of the rows: for large tables use ``mmd_rbf_rff``, whose error is about 1 / sqrt(n_features)."""
    ref, made = (cut_lineage(df.select(F.col(vec).alias("x"), F.lit(0).alias("code")).where("x IS NOT NULL"), "mmd-side") for df in (real, syn))
    nr, ns = ref.count(), made.count()
    if not nr or not ns:
        return real.sparkSession.createDataFrame([("mmd_rbf", None)], "metric string, score double")
    names = F.array(F.struct(F.lit("syn").alias("source"), F.lit(ns).alias("n"), F.lit(0).alias("code")))
    return _mmd_by_source(ref, made, names, nr, gamma, block).select(F.lit("mmd_rbf").alias("metric"), "score")


def _side_sums(gamma: float):
    """Kernel sums over ordered pairs of two blocks by sides (-1: the reference), for pairs with the reference or of one side."""
    import numpy as np
    import pandas as pd

    def fn(pdf):
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, side, block = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["side"].to_numpy(), pdf["block"].to_numpy()
        a, b = block == i, block == j
        square, names = (x * x).sum(axis=1), np.unique(side)
        right, far = (side[b][:, None] == names[None]).astype(float), x[b].T
        rows_a, sums = np.flatnonzero(a), np.zeros((len(names), len(names)))
        for s in range(0, len(rows_a), MMD_BLOCK):  # a bounded piece of the kernel matrix
            at = rows_a[s:s + MMD_BLOCK]
            kernel = x[at] @ far
            kernel *= -2
            kernel += square[at][:, None]
            kernel += square[b][None, :]
            np.maximum(kernel, 0.0, out=kernel)
            kernel *= -gamma
            np.exp(kernel, out=kernel)
            sums += (side[at][None] == names[:, None]).astype(float) @ (kernel @ right)
        sums *= 1.0 if i == j else 2.0
        sums = (sums + sums.T) / 2
        rows = [(int(p), int(q), sums[m, n]) for m, p in enumerate(names) for n, q in enumerate(names) if p == q or p == -1]
        return pd.DataFrame(rows, columns=["p", "q", "k"])

    return fn


def _mmd_by_source(ref: DataFrame, syn: DataFrame, names, n_ref: int, gamma: float, block: int = MMD_BLOCK) -> DataFrame:
    """(source, score) for every source in ``names`` (array of source, n, code) whose rows are in ``syn`` (x, code)."""
    both = cut_lineage(ref.select("x", F.lit(-1).alias("side")).unionByName(syn.select("x", F.col("code").alias("side"))), "mmd-rows")
    n = both.count()
    blocks = -(-n // max(block, min(MMD_LARGEST, n // MMD_BLOCKS)))
    dealt = both.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    groups = other.select("x", "side", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sums = groups.groupBy("i", "j").applyInPandas(_side_sums(gamma), "p int, q int, k double").groupBy("p", "q").agg(F.sum("k").alias("k"))
    at = sums.withColumn("s", F.explode(names)).where("(p = -1 AND q IN (-1, s.code)) OR (p = s.code AND q = s.code)")
    m, n_syn = float(n_ref), F.col("s.n").cast("double")  # the square of a count doesn't fit an integer
    term = (F.when(F.col("q") == -1, F.col("k") / (m * m)).when(F.col("p") == -1, -2 * F.col("k") / (m * n_syn))
            .otherwise(F.col("k") / (n_syn * n_syn)))
    return at.groupBy("s.source").agg(F.sum(term).alias("score"))


def mmd_rbf_rff(real: DataFrame, syn: DataFrame, cols: Sequence[str], gamma: float = 1.0,
                n_features: int = 256, seed: int = 0) -> DataFrame:
    """RBF-kernel MMD by random Fourier features: ||mean phi(X) - mean phi(Y)||^2.

    Every row contributes (no sampling of rows); only the kernel is approximated,
    so the work is one aggregate per table instead of all pairs.
    """
    import numpy as np
    rng = np.random.default_rng(seed)
    W = rng.normal(0, math.sqrt(2 * gamma), size=(n_features, len(cols)))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    names = list(cols)

    def sums(batches):
        import pyarrow as pa
        n, total = 0, np.zeros(n_features)
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
            for s in range(0, len(x), 4096):
                total += np.cos(x[s:s + 4096] @ W.T + b).sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "s"])

    def mean_phi(df):
        part = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(sums, "n long, s array<double>")  # one row per task
        whole = part.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(n_features)]).first()
        return np.array([whole[f"s{i}"] for i in range(n_features)]) / whole["n"]  # n_features values

    fa, fb = mean_phi(real), mean_phi(syn)
    val = float(np.sum((scale * (fa - fb)) ** 2))
    return real.sparkSession.createDataFrame([("mmd_rbf", float(val))], "metric string, score double")


# ------------------------------------------------------------------ Q0
REPORT = ("alpha_precision", "inv_kl", "jsd", "mmd", "prdc", "wasserstein", "nearest_distance")


def _in_range(bins: int):
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins
    return F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(bins - 1))).cast("int")


def quality_report(sources: DataFrame, reference: DataFrame, vec: str, id_col: str, src: str = "source", metrics: Sequence[str] = REPORT,
                   k: int = 5, bins: int = 10, gamma: float = 1.0, n_pivots: int | None = None, seed=42) -> DataFrame:
    """Long report ``(metric, component, source, score, error)``: every metric for every source at once.

    The number of jobs doesn't depend on the number of sources: columns go through the histograms and running
    counts keyed by (source, column), rows through neighbour searches in which the source is a further
    coordinate, wider than any distance, so that only rows of one source meet. The reference is repeated per
    source where a source looks for its own rows. A source that can't be scored (a missing or non-finite
    cell, a vector of another length, fewer than k + 1 rows) has rows with an error instead of a score, found by
    validation; an unknown metric has an error for every source. ``mmd`` is exact (square of the rows)."""
    spark = sources.sparkSession
    take = lambda df, *more: df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("x"), *more)
    rows = cut_lineage(take(sources, F.col(src).cast("string").alias("source")), "report-rows")
    ref = cut_lineage(take(reference), "report-reference")
    odd = F.col("x").isNull() | F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    width = ref.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n"), F.sum((odd | (F.size("x") < 1)).cast("long")).alias("bad"),
                    F.min(F.size("x")).alias("least")).first()
    sized = odd | (F.size("x") != F.lit(width["d"] or 0))
    checked = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(sized.cast("long")).alias("bad"))
    ref_error = None
    if width["n"] <= k or width["bad"] or width["least"] != width["d"]:
        ref_error = "the reference needs more than k whole rows of one length"
    error = F.coalesce(F.lit(ref_error).cast("string"), F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" rows with missing or odd cells")))
                       .when(F.col("n") <= k, F.lit("fewer than k + 1 rows")))
    by_code = Window.orderBy("source")  # one row per source
    checked = cut_lineage(checked.select("source", "n", error.alias("error"), (F.row_number().over(by_code) - 1).cast("int").alias("code")), "report-sources")
    empty = "metric string, component string, source string, score double, error string"
    known = [m for m in metrics if m in REPORT]
    out = checked.where("error IS NOT NULL").select(F.explode(F.array(*map(F.lit, metrics))).alias("metric"), F.lit(None).cast("string").alias("component"),
                                                    "source", F.lit(None).cast("double").alias("score"), "error")
    for m in metrics:
        if m not in REPORT:
            out = out.unionByName(checked.where("error IS NULL").select(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("component"), "source",
                                                                       F.lit(None).cast("double").alias("score"), F.lit(f"unknown metric {m}").alias("error")))
    good = checked.where("error IS NULL").select("source", "n", "code")
    if not known or ref_error or not good.take(1):
        return out
    names = F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["n"]).alias("n"), F.lit(r["code"]).alias("code")) for r in good.collect()])  # source names
    syn = cut_lineage(attach(rows, good, ["source"]).where("code IS NOT NULL"), "report-good")
    scores = []
    add = lambda metric, df, value="score", component=None: scores.append(df.select(
        F.lit(metric).alias("metric"), (component if component is not None else F.lit(None)).cast("string").alias("component"), "source", F.col(value).alias("score")))
    if {"inv_kl", "jsd", "wasserstein"} & set(known):
        rl = cut_lineage(ref.select(F.posexplode("x").alias("col", "v")).groupBy("col", "v").agg(F.count("*").alias("c")), "report-real-values")
        sl = cut_lineage(syn.select("source", F.posexplode("x").alias("col", "v")).groupBy("source", "col", "v").agg(F.count("*").alias("c")), "report-syn-values")
        both = sl.select("source", "col", "v", F.lit(0).cast("long").alias("cr"), F.col("c").alias("cs")).unionByName(
            rl.select(F.explode(names).alias("s"), "col", "v", F.col("c").alias("cr"), F.lit(0).cast("long").alias("cs"))
            .select("s.source", "col", "v", "cr", "cs"))
        if {"inv_kl", "jsd"} & set(known):
            rng = rl.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            binned = attach(both, rng, ["col"]).groupBy("source", "col", _in_range(bins).alias("bin")).agg(
                F.sum("cr").alias("n_real"), F.sum("cs").alias("n_syn"))
            w = Window.partitionBy("source", "col")  # bins
            hist = cut_lineage(binned.select("source", "col", "bin", (F.col("n_real") / F.sum("n_real").over(w)).alias("p"),
                                             (F.col("n_syn") / F.sum("n_syn").over(w)).alias("q")), "report-bins")
            if "inv_kl" in known:
                add("inv_kl", inverse_kl(hist, ["source", "col"]).groupBy("source").agg(F.avg("score").alias("score")))
            if "jsd" in known:
                add("jsd", jensen_shannon(hist, ["source", "col"]).groupBy("source").agg(F.avg("distance").alias("score")))
        if "wasserstein" in known:
            gaps = _gaps(both.groupBy("source", "col", "v").agg(F.sum("cr").alias("cr"), F.sum("cs").alias("cs")), ["source", "col"])
            per = gaps.groupBy("source", "col").agg(F.sum(F.abs("gap") * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))).alias("d"))
            add("wasserstein", per.groupBy("source").agg(F.avg("d").alias("score")))
    if "mmd" in known:
        add("mmd", _mmd_by_source(ref, syn, names, width["n"], gamma))
    if {"prdc", "nearest_distance", "alpha_precision"} & set(known):
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        top = ref.select(norm.alias("m")).unionByName(syn.select(norm.alias("m"))).agg(F.max("m")).first()[0]
        wide = 4 * math.sqrt(top) + 1
        apart = lambda df: df.withColumn("x", F.concat("x", F.array(F.col("code") * F.lit(wide))))
        own = F.concat(F.col("code").cast("string"), F.lit("|"), F.col("id"))
        repeated = ref.select("id", "x", F.explode(names).alias("s")).select("s.*", "id", "x")
        if {"prdc", "nearest_distance"} & set(known):
            for metric, component, df in _neighbour_scores(ref, apart(repeated).withColumn("id", own), syn, apart(syn).withColumn("id", own), width["n"], k, n_pivots, known):
                add(metric, df, component=F.lit(component))
        if "alpha_precision" in known:
            for component, df in _alpha_scores(ref, repeated, syn, apart, own, width["n"], n_pivots, seed):
                add("alpha_precision", df, component=F.lit(component))
    for one in scores:
        out = out.unionByName(one.withColumn("error", F.lit(None).cast("string")))
    return spark.createDataFrame([], empty).unionByName(out)


def _neighbour_scores(ref, repeated, syn, syn_apart, n_ref: int, k: int, n_pivots, known):
    """PRDC and the nearest synthetic distance per source: (metric, component, (source, score))."""
    near = dst.knn(repeated, syn_apart.withColumnRenamed("id", "nb"), 1, "id", "nb", "x", n_pivots=n_pivots)
    near = cut_lineage(near.join(repeated.select("id", "source"), "id").select("id", "source", "d"), "report-nearest")
    if "nearest_distance" in known:
        ends = near.groupBy("source").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        yield "nearest_distance", None, attach(near, ends, ["source"]).groupBy("source").agg(F.avg(scaled).alias("score"))
    if "prdc" not in known:
        return
    real_index = dst.PivotIndex(ref, "id", "x", n_pivots=n_pivots)
    syn_index = dst.PivotIndex(syn_apart.select("id", "x"), "id", "x", n_pivots=n_pivots)
    r_real = cut_lineage(dst.kth_distance(ref, "id", k, "x", index=real_index).withColumnRenamed("radius", "r"), "report-real-balls")
    r_syn = cut_lineage(dst.kth_distance(syn_apart.select("id", "x"), "id", k, "x", index=syn_index).withColumnRenamed("radius", "r"), "report-syn-balls")
    own = syn.select(F.concat(F.col("code").cast("string"), F.lit("|"), F.col("id")).alias("q"), "x", "source", "n")
    inside = dst.range_counts(own.select("q", "x"), r_real, "q", "id", "r", "x", index=real_index).withColumnRenamed("n", "hits")
    counted = cut_lineage(own.select("q", "source", "n").join(inside, "q", "left"), "report-inside")
    yield "prdc", "precision", counted.groupBy("source").agg(F.avg((F.coalesce("hits", F.lit(0)) > 0).cast("double")).alias("score"))
    yield "prdc", "density", counted.groupBy("source").agg((F.sum(F.coalesce("hits", F.lit(0))) / (k * F.count("*"))).alias("score"))
    hits = dst.range_counts(repeated.select(F.col("id").alias("q"), "x"), r_syn, "q", "id", "r", "x", index=syn_index).withColumnRenamed("n", "hits")
    held = repeated.select(F.col("id").alias("q"), "source").join(hits, "q", "left")
    yield "prdc", "recall", held.groupBy("source").agg(F.avg((F.coalesce("hits", F.lit(0)) > 0).cast("double")).alias("score"))
    covered = near.withColumn("rid", F.expr("substring(id, length(substring_index(id, '|', 1)) + 2)")).drop("id").join(r_real.withColumnRenamed("id", "rid"), "rid")
    yield "prdc", "coverage", covered.groupBy("source").agg((F.sum((F.col("d") < F.col("r")).cast("double")) / n_ref).alias("score"))


def _alpha_scores(ref, repeated, syn, apart, own, n_ref: int, n_pivots, seed):
    """Alpha-precision, beta-recall and authenticity per source after matching sizes: (component, (source, score))."""
    ranked = smp.hash_rank_within(ref.withColumn("g", F.lit(0)), ["g"], "id", F.lit(str(seed)), "rank").select("id", "rank")
    size = F.least(F.col("n"), F.lit(n_ref))
    real = cut_lineage(repeated.join(ranked, "id").where(F.col("rank") < size), "report-matched-real")
    made = cut_lineage(smp.hash_rank_within(syn, ["source"], "id", F.lit(str(seed)), "rank").where(F.col("rank") < size), "report-matched-syn")
    for component, inner, outer in (("delta_precision_alpha", real, made), ("delta_coverage_beta", made, real)):
        means = inner.select("source", F.posexplode("x").alias("i", "v")).groupBy("source", "i").agg(F.avg("v").alias("v"))
        center = means.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c")).select(
            "source", F.transform("c", lambda e: e["v"]).alias("center"))  # one entry per dimension
        center = cut_lineage(center, "report-centers")
        to_center = lambda df: attach(df, center, ["source"]).select("source", dst.dist(F.col("x"), F.col("center")).alias("r"))  # noqa: E731, B023
        radii = quantiles_by(to_center(inner), ["source"], "r", ALPHAS)
        shares = attach(to_center(outer), radii, ["source"]).groupBy("source").agg(
            *[F.avg((F.col("r") <= F.get("q", F.lit(i))).cast("double")).alias(f"a{i}") for i in range(len(ALPHAS))])
        gap = sum((F.abs(F.col(f"a{i}") - F.lit(a)) for i, a in enumerate(ALPHAS)), F.lit(0.0))
        yield component, shares.select("source", (1 - 2 * gap / len(ALPHAS)).alias("score"))
    real_apart, made_apart = (apart(df).withColumn("id", own) for df in (real, made))
    r1 = dst.kth_distance(real_apart.select("id", "x"), "id", 1, "x", n_pivots).withColumnRenamed("radius", "r1")
    near = dst.knn(made_apart.select(F.col("id").alias("q"), "x"), real_apart.select("id", "x"), 1, "q", "id", "x", n_pivots=n_pivots)
    with_source = near.join(made_apart.select(F.col("id").alias("q"), "source"), "q").join(r1, "id")
    yield "authenticity", with_source.groupBy("source").agg(F.avg((F.col("r1") < F.col("d")).cast("double")).alias("score"))
