"""Exact nearest-neighbour building block (Q11) without all-pairs.

Vectors are ``ARRAY<DOUBLE>``. The reference side is partitioned into cells
around ``m`` pivots (rows with the smallest ``h(id)``, a bounded set). For
every query row the triangle inequality gives, per cell ``c`` with pivot
``p_c`` and covering radius ``R_c``:

    d(q, x) >= d(q, p_c) - R_c     for every x in c        (lower bound)
    d(q, x) <= d(q, p_c) + R_c                             (upper bound)

The k-th neighbour distance is at most the smallest upper bound whose cells
hold >= k points, so only cells whose lower bound is below that can contain
a neighbour. Query rows are exploded over those candidate cells and
equi-joined on ``(cell, sub)``; cells larger than ``bucket_rows`` are split
into hash sub-buckets so a hot cell never lands in one task. The result is
exact; the pruning only changes how much work is done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.functions.hashing import h
from rowsift.functions.literals import const_array
from rowsift.operators.attach import attach
from rowsift.session import cut_lineage


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


QUERY_BLOCK_ROWS = 16384
BUCKET_ROWS = 16384
TILE = 1_000_000  # pairs of a tile
RUN = 32  # columns of a tile whose minimum is taken at once


def _exact(Q, R, qi, ri):
    """Distances of the pairs (qi, ri) from the differences, in bounded pieces."""
    import numpy as np

    out, piece = np.empty(len(qi)), max(1, TILE // max(1, Q.shape[1]))
    for s in range(0, len(qi), piece):
        diff = Q[qi[s:s + piece]] - R[ri[s:s + piece]]
        out[s:s + piece] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _near_pairs(Q, R, kk: int):
    """Per tile of queries (first row, query places in the tile, reference places): a superset of each query's kk nearest
    references with every tie at the kk-th place.

    Squared distances (less the query's own norm) come from a product of single-precision matrices, centred at the
    references. Its rounding error is bounded by `slack`; the kk-th smallest of the minima of disjoint runs of
    references is no smaller than the kk-th distance, so only runs whose minimum reaches it are looked into."""
    import numpy as np

    center = R.mean(axis=0)
    q, r = Q - center, R - center
    qn, rn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    largest = rn.max()
    single = max(largest, qn.max()) < 1e30
    kind, eps = (np.float32, 2.0 ** -24) if single else (np.float64, 2.0 ** -53)
    slack = 4 * (Q.shape[1] + 8) * eps * (qn + largest)
    if single:
        slack += 1e-30  # products below the smallest normal number
    runs = -(-len(R) // RUN)
    right = np.zeros((Q.shape[1] + 1, runs * RUN), dtype=kind)
    right[:-1, :len(R)] = r.T
    right[-1, :len(R)], right[-1, len(R):] = rn, np.inf
    left = np.ones((len(Q), Q.shape[1] + 1), dtype=kind)
    left[:, :-1] = q
    left[:, :-1] *= -2
    step, inside = max(1, TILE // right.shape[1]), np.arange(RUN) * runs
    for s in range(0, len(Q), step):
        sq = left[s:s + step] @ right
        least = sq.reshape(len(sq), RUN, runs).min(axis=1)  # a run: columns run, run + runs, ...
        reach = np.full(len(sq), np.inf)
        if kk <= runs:
            reach = np.partition(least, kk - 1, axis=1)[:, kk - 1].astype(np.float64) + 2 * slack[s:s + step]
        qi, run = np.nonzero(least <= reach[:, None])
        piece = max(1, TILE // RUN)
        found = []
        for t in range(0, len(qi), piece):
            rows, cols = qi[t:t + piece, None], run[t:t + piece, None] + inside
            at, j = np.nonzero((sq[rows, cols] <= reach[rows]) & (cols < len(R)))
            found.append((rows[at, 0], cols[at, j]))
        yield s, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _block_kernel(mode: str, k: int, exclude_self: bool):
    """numpy kernel for one (cell, sub, query-block) group: exact distances of the block's
    queries to the cell's reference rows; emits per-query top-k ('knn') or, per query, the number of
    balls it lies in ('range': one row per query, `_rid` null, the count as `d`).

    Tiles of squared distances come from a matrix product; its rounding error is bounded by `slack`, and every pair
    that this error could decide is computed again from the differences."""
    import numpy as np
    import pandas as pd

    def nearest(Q, R, qid, rid, id_rank, qcode, rcode):
        finite_q, finite_r = (np.flatnonzero(np.isfinite(np.einsum("ij,ij->i", x, x))) for x in (Q, R))  # others are near nothing
        kk = k
        if exclude_self and len(finite_r):
            kk += int(np.unique(rcode[finite_r], return_counts=True)[1].max())  # rows of the query's own id are dropped below
        oq, orr, od = [qid[:0]], [rid[:0]], [np.zeros(0)]
        if len(finite_q) and len(finite_r):
            for s, qi, ri in _near_pairs(Q[finite_q], R[finite_r], kk):
                qi, ri = finite_q[s + qi], finite_r[ri]
                if exclude_self:
                    other = qcode[qi] != rcode[ri]
                    qi, ri = qi[other], ri[other]
                d = _exact(Q, R, qi, ri)
                order = np.lexsort((id_rank[ri], d, qi))
                qi, ri, d = qi[order], ri[order], d[order]
                keep = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < k
                oq.append(qid[qi[keep]])
                orr.append(rid[ri[keep]])
                od.append(d[keep])
        return pd.DataFrame({"_qid": np.concatenate(oq), "_rid": np.concatenate(orr), "d": np.concatenate(od)})

    def fn(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"_qid": qpdf["_qid"].iloc[:0], "_rid": rpdf["_rid"].iloc[:0], "d": np.zeros(0)})
        Q = np.stack(qpdf["_qv"].to_numpy()).astype(np.float64)
        R = np.stack(rpdf["_rv"].to_numpy()).astype(np.float64)
        qid, rid = qpdf["_qid"].to_numpy(), rpdf["_rid"].to_numpy()
        id_rank = np.unique(rid, return_inverse=True)[1]  # ties in distance go to the smaller id
        qcode, rcode = qid, rid
        if qid.dtype == object or rid.dtype == object:
            codes = pd.factorize(np.concatenate([qid.astype(object), rid.astype(object)]))[0]
            qcode, rcode = codes[:len(qid)], codes[len(qid):]
        if mode != "range":
            return nearest(Q, R, qid, rid, id_rank, qcode, rcode)
        rad = rpdf["_rad"].to_numpy().astype(np.float64)
        qn, rn = np.einsum("ij,ij->i", Q, Q), np.einsum("ij,ij->i", R, R)
        slack = 1e-14 * (Q.shape[1] + 4) * (qn + np.nanmax(rn))
        oq, od = [], []
        step = max(1, TILE // R.shape[0])
        for s in range(0, Q.shape[0], step):
            part = Q[s:s + step]
            sq = part @ R.T
            sq *= -2
            sq += qn[s:s + step, None]
            sq += rn[None, :]
            if exclude_self:
                sq[qcode[s:s + step, None] == rcode[None, :]] = np.inf
            gap = sq - rad * rad
            qi, ri = np.nonzero(np.abs(gap) <= slack[s:s + step, None] + 1e-14 * rad * rad)
            gap[qi, ri] = np.where(_exact(part, R, qi, ri) < rad[ri], -1.0, 1.0)
            oq.append(qid[s:s + step])
            od.append((gap < 0).sum(axis=1).astype(np.float64))
        return pd.DataFrame({"_qid": np.concatenate(oq), "_rid": pd.Series([None] * sum(map(len, oq)), dtype=object), "d": np.concatenate(od)})

    return fn


PIVOT_NUMBERS = 65_536  # differences held at once, so that they stay in a core's cache


def _to_pivots(pivots):
    """Batches of vectors -> (place of the first, distances to every pivot; NaN for a vector that is null, of another length or holds no number)."""
    import numpy as np

    P = np.array(pivots, dtype=np.float64)
    step = max(1, PIVOT_NUMBERS // max(1, P.size))

    def fn(v):
        for s in range(0, len(v), step):
            rows = [x if x is not None and len(x) == P.shape[1] else None for x in v.iloc[s:s + step]]
            whole = np.stack([np.full(P.shape[1], np.nan) if x is None else np.asarray(x, dtype=np.float64) for x in rows])
            diff = whole[:, None, :] - P[None, :, :]
            found = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            found[np.isnan(found).any(axis=1)] = np.nan
            yield s, found

    return fn


def _pivot_distances(pivots: list):
    """Distances to every pivot per vector; null for a vector without them."""
    import numpy as np
    import pandas as pd

    distances = _to_pivots(pivots)

    def fn(v):
        return pd.Series([None if np.isnan(r[0]) else r for _, found in distances(v) for r in found], dtype=object)

    return fn


def _nearest_pivot(pivots: list):
    """(distance to the nearest pivot, its place) per vector; null for a vector without distances."""
    import numpy as np
    import pandas as pd

    distances = _to_pivots(pivots)

    def fn(v):
        far, cell = np.full(len(v), np.nan), np.full(len(v), -1)
        for s, found in distances(v):
            whole = ~np.isnan(found[:, 0])
            cell[s:s + len(found)][whole] = found[whole].argmin(axis=1)
            far[s:s + len(found)] = found.min(axis=1)
        cell = pd.arrays.IntegerArray(cell.astype(np.int32), cell < 0)
        return pd.DataFrame({"_pdist": far, "_cell": pd.Series(cell)})  # NaN becomes null

    return fn


def _cells_in_reach(pivots: list, counts: list, radii: list, need: int):
    """The cells that can hold one of the ``need`` nearest rows of a vector; none for a vector without distances."""
    import numpy as np
    import pandas as pd

    distances, n, R = _to_pivots(pivots), np.array(counts), np.array(radii)
    held = n > 0

    def fn(v):
        out = []
        for _, found in distances(v):
            far = np.where(held, found + R, np.inf)
            order = np.argsort(far, axis=1, kind="stable")
            enough = np.cumsum(n[order], axis=1) >= need
            at = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
            bound = np.where(enough.any(axis=1), at, np.inf)
            open_cells = held & (found - R <= bound[:, None])  # NaN: none
            out.extend(np.flatnonzero(row).astype(np.int32) for row in open_cells)
        return pd.Series(out, dtype=object)

    return fn


def _vector_udf(fn, schema: str):
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pandas_udf(fn, schema, PandasUDFType.SCALAR)


def _block_pairs(cand: DataFrame, refp: DataFrame, mode: str, k: int = 0, exclude_self: bool = False) -> DataFrame:
    """Route candidate (query, cell, sub) rows and reference (cell, sub) rows into bounded groups
    (query blocks of <= QUERY_BLOCK_ROWS per cell-sub; the cell's reference rows are repeated per
    block) and run the numpy kernel per group. Emits at most k rows per query per group."""
    counts = cand.groupBy("_qcell", "_qsub").agg(F.ceil(F.count("*") / QUERY_BLOCK_ROWS).cast("int").alias("_nb"))
    q = attach(cand, counts, ["_qcell", "_qsub"])
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_nb")).cast("int"))
    q = q.select(F.col("_qcell").alias("_c"), F.col("_qsub").alias("_sb"), "_qb", "_qid", "_qv")
    r = attach(refp, counts.select(F.col("_qcell").alias("_cell"), F.col("_qsub").alias("_sub"), "_nb"), ["_cell", "_sub"])
    r = r.where("_nb IS NOT NULL").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rcols = ["_rid", "_rv"] + (["_rad"] if mode == "range" else [])
    r = r.select(F.col("_cell").alias("_c"), F.col("_sub").alias("_sb"), "_qb", *rcols)
    schema = f"_qid {dict(cand.dtypes)['_qid']}, _rid {dict(refp.dtypes)['_rid']}, d double"
    fn = _block_kernel(mode, k, exclude_self)
    return (q.groupBy("_c", "_sb", "_qb").cogroup(r.groupBy("_c", "_sb", "_qb"))
             .applyInPandas(lambda a, b: fn(a, b), schema))


class PivotIndex:
    """Cells over a reference table; pivot vectors and per-cell stats are small literals."""

    def __init__(self, ref: DataFrame, id_col: str, vec: str, n_pivots: int | None = None,
                 seed: int = 7, bucket_rows: int = BUCKET_ROWS, extra_max: str | None = None):
        self.id_col, self.vec = id_col, vec
        n = self.n_rows = ref.count()
        m = n_pivots or max(1, min(256, int(math.sqrt(max(n, 1)) // 2) or 1))
        piv = (ref.select(F.col(vec).alias("_pv"), h(id_col, f"pivot{seed}").alias("_ph"), F.col(id_col))
                  .orderBy("_ph", id_col).limit(m).collect())  # m rows: bounded by n_pivots
        self.pivots = [list(map(float, r["_pv"])) for r in piv]
        self.m = len(self.pivots)
        self._plit = const_array(self.pivots, "array<double>")
        if self.pivots:
            near = _vector_udf(_nearest_pivot(self.pivots), "_pdist double, _cell int")
            assigned = ref.withColumn("_near", near(F.col(vec).cast("array<double>"))).select(*ref.columns, "_near._pdist", "_near._cell")
        else:
            assigned = self.assign(ref).drop("_pd")
        cells = cut_lineage(assigned, "pivot-cells")
        aggs = [F.count("*").alias("n"), F.max("_pdist").alias("R")]
        if extra_max:
            aggs.append(F.max(extra_max).alias("X"))
        stats = {r["_cell"]: r for r in cells.groupBy("_cell").agg(*aggs).collect()}  # <= m rows
        self.n_c = [int(stats[c]["n"]) if c in stats else 0 for c in range(self.m)]
        self.R_c = [float(stats[c]["R"]) if c in stats else 0.0 for c in range(self.m)]
        self.X_c = [float(stats[c]["X"] or 0.0) if (extra_max and c in stats) else 0.0 for c in range(self.m)]
        self.subs = [max(1, math.ceil(nc / bucket_rows)) for nc in self.n_c]
        self.ref = (cells.withColumn("_sub", F.pmod(F.xxhash64(F.col(id_col)),
                                                    F.element_at(const_array(self.subs, "int"),
                                                                 F.col("_cell") + 1)).cast("int")))

    # distances to every pivot, nearest cell, distance to it
    def assign(self, df: DataFrame) -> DataFrame:
        v = F.col(self.vec)
        if self.pivots:
            distances = _vector_udf(_pivot_distances(self.pivots), "array<double>")
            out = df.withColumn("_pd", distances(v.cast("array<double>")))
        else:
            out = df.withColumn("_pd", F.transform(self._plit, lambda p: dist(p, v)))
        best = F.array_min(F.col("_pd"))
        return (out.withColumn("_pdist", best)
                   .withColumn("_cell", (F.array_position(F.col("_pd"), best) - 1).cast("int")))

    def _lits(self):
        return (const_array(self.n_c, "bigint"), const_array(self.R_c), const_array(self.X_c),
                const_array(self.subs, "int"))

    def explode_candidates(self, q: DataFrame, need: int) -> DataFrame:
        """Explode query rows over the cells that can hold one of their ``need`` nearest rows
        and over each candidate cell's sub-buckets."""
        s_lit = self._lits()[3]
        v = F.col(self.vec).cast("array<double>")
        if self.pivots:
            cells = _vector_udf(_cells_in_reach(self.pivots, self.n_c, self.R_c, need), "array<int>")(v)
        else:
            cells = F.array().cast("array<int>")
        out = cut_lineage(q.withColumn("_cells", cells), "query-cells").withColumn("_qcell", F.explode("_cells"))
        out = out.withColumn("_qsub", F.explode(F.sequence(F.lit(0), F.element_at(s_lit, F.col("_qcell") + 1) - 1)))
        return out


def knn(query: DataFrame, ref: DataFrame | None, k: int, q_id: str, r_id: str, vec: str = "embedding",
        exclude_self: bool = False, index: PivotIndex | None = None, n_pivots: int | None = None) -> DataFrame:
    """Exact k nearest reference rows for every query row: ``(q_id, r_id, d, rank)``.

    ``index`` (built once on the reference) can be reused across searches;
    ``exclude_self`` drops pairs with equal ids (query and reference are the same table).
    """
    idx = index or PivotIndex(ref, r_id, vec, n_pivots=n_pivots)
    need = k + 1 if exclude_self else k
    qa = query.select(F.col(q_id).alias("_qid"), F.col(vec).alias(idx.vec))
    cand = idx.explode_candidates(qa, need).select("_qid", F.col(idx.vec).alias("_qv"), "_qcell", "_qsub")
    refp = idx.ref.select(F.col(idx.id_col).alias("_rid"), F.col(idx.vec).alias("_rv"), "_cell", "_sub")
    pairs = _block_pairs(cand, refp, "knn", k=k, exclude_self=exclude_self)
    w = Window.partitionBy("_qid").orderBy("d", "_rid")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("_qid").alias(q_id), F.col("_rid").alias(r_id), "d", "rank")


def kth_distance(df: DataFrame, id_col: str, k: int, vec: str = "embedding",
                 n_pivots: int | None = None, index: PivotIndex | None = None) -> DataFrame:
    """Distance from every row to its k-th nearest *other* row of the same table: ``(id, radius)``."""
    idx = index or PivotIndex(df, id_col, vec, n_pivots=n_pivots)
    nn = knn(df, None, k, id_col, "_ref_id", vec, exclude_self=True, index=idx)
    return nn.where(F.col("rank") == k).select(id_col, F.col("d").alias("radius"))


def range_counts(query: DataFrame, ref: DataFrame, q_id: str, r_id: str, radius: str, vec: str = "embedding",
                 n_pivots: int | None = None, index: PivotIndex | None = None) -> DataFrame:
    """``(q_id, n)``: for every query row with a candidate cell, the number of reference rows r with
    d(q, r) < radius(r) (reference rows carry their own ball radius). Counted where the distances are
    computed: a task gives one row per query, never a pair.

    Candidate cells: lower bound d(q, p_c) - R_c < max radius in c (one small aggregate).
    """
    idx = index or PivotIndex(ref, r_id, vec, n_pivots=n_pivots)
    rr = idx.ref.join(ref.select(F.col(r_id).alias(idx.id_col), F.col(radius).alias("_rad")), idx.id_col)
    xmax = {r["_cell"]: float(r["x"]) for r in rr.groupBy("_cell").agg(F.max("_rad").alias("x")).collect()}  # <= m rows
    x_lit = const_array([xmax.get(c, 0.0) for c in range(idx.m)])
    n_lit, r_lit, _, s_lit = idx._lits()
    qa = idx.assign(query.select(F.col(q_id).alias("_qid"), F.col(vec).alias(idx.vec)))
    cells = F.filter(F.sequence(F.lit(0), F.lit(idx.m - 1)),
                     lambda c: (F.element_at(n_lit, c + 1) > 0)
                     & (F.element_at(F.col("_pd"), c + 1) - F.element_at(r_lit, c + 1) < F.element_at(x_lit, c + 1)))
    cand = cut_lineage(qa.withColumn("_cells", cells).drop("_pd"), "query-cells").withColumn("_qcell", F.explode("_cells"))
    cand = cand.withColumn("_qsub", F.explode(F.sequence(F.lit(0), F.element_at(s_lit, F.col("_qcell") + 1) - 1)))
    cand = cand.select("_qid", F.col(idx.vec).alias("_qv"), "_qcell", "_qsub")
    refp = rr.select(F.col(idx.id_col).alias("_rid"), F.col(idx.vec).alias("_rv"), "_rad", "_cell", "_sub")
    counted = _block_pairs(cand, refp, "range")
    return counted.groupBy(F.col("_qid").alias(q_id)).agg(F.sum("d").cast("long").alias("n"))
