"""Exact top-k inner-product search by columnar branch and bound.

Candidates are packed into blocks in vertical layout (one row of the matrix per dimension) with
the norms of what remains after each dimension block. A task takes one block of queries and a
stripe of candidate blocks. For a tile of queries it adds up the products dimension block by
dimension block; after each, a candidate stays only if for some query of the tile the sum so far
plus the product of the remaining norms (Cauchy-Schwarz) reaches that query's k-th best score.
The survivors' columns are compacted before the next dimension block.

Scale: the query set meets all rows in blocks. Blocks are rows of bounded size; a query block is
copied to each stripe and a candidate block to each query block, so a task's work and memory are
bounded and nothing is broadcast. Each (query, stripe) sends k rows to the last ranking. Blocks are dealt
by the hash of the id, so equal vectors, however many, spread evenly.

Scores are exact integers: sums run in float64 only where every partial sum stays below 2**53,
else in Python integers, ending at the limits of 64 bits. Defined results: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; only vectors of the same length are compared;
rows with the query's id are its own; rows with one query id count as one query; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SCALE = 64
BLOCK = 4096
QUERIES = 1024
STRIPE = 4
TILE = 16
STEP = 16

PACKED = "dim int, block long, n int, ids binary, matrix binary"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as bigint."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _pack(pdf):
    import pandas as pd

    pdf = pdf.sort_values("id", kind="stable")
    matrix = np.stack(pdf["v"].to_list()).astype(np.int64).T  # a row per dimension
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)],
                         "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "matrix": [np.ascontiguousarray(matrix).tobytes()]})


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """(id, dim, v) as blocks of about equal size, by the hash of the id."""
    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")) \
        .groupBy("dim", "block").applyInPandas(_pack, PACKED)


def rest_norms(matrix: np.ndarray) -> list[np.ndarray]:
    """Upper bounds of the columns' norms over the dimensions from each dimension block's end on."""
    squares = matrix.astype(np.float64) ** 2
    return [np.sqrt(squares[d:].sum(axis=0)) * (1 + 1e-9) for d in range(STEP, matrix.shape[0] + STEP, STEP)]


class Best:
    """The k best (score, id) of a query: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~scores))[:self.k]  # ~x falls as x rises
        self.scores, self.ids = scores[order], ids[order]


def search_block(queries: np.ndarray, query_ids: np.ndarray, best: list[Best], matrix: np.ndarray, ids: np.ndarray) -> None:
    """Adds a candidate block (dims x n) to the best of the queries (dims x m)."""
    dims = matrix.shape[0]
    top = lambda m: max(abs(int(m.min())), abs(int(m.max())), 1)
    exact = top(queries) * top(matrix) * dims < 2**52
    if not exact:
        for k, own in enumerate(query_ids):
            other = ids != own
            q = queries[:, k].tolist()
            scores = [min(max(sum(map(int.__mul__, col, q)), -(2**63)), 2**63 - 1) for col in matrix[:, other].T.tolist()]
            best[k].add(np.array(scores, np.int64), ids[other])
        return
    x, q = matrix.astype(np.float64), queries.astype(np.float64)
    x_rest, q_rest = rest_norms(matrix), rest_norms(queries)
    for a in range(0, q.shape[1], TILE):
        tile = slice(a, a + TILE)
        least = np.array([b.least for b in best[tile]])
        alive, sums = np.arange(len(ids)), np.zeros((len(least), len(ids)))
        for k, d in enumerate(range(0, dims, STEP)):
            sums += q[d:d + STEP, tile].T @ (x[d:d + STEP] if len(alive) == len(ids) else x[d:d + STEP, alive])
            if d + STEP < dims and np.isfinite(least).any():
                bound = sums + q_rest[k][tile, None] * x_rest[k][alive] + 1e-6
                keep = (bound >= least[:, None]).any(axis=0)
                if keep.mean() < 0.8:
                    alive, sums = alive[keep], sums[:, keep]
        for k, b in enumerate(best[tile]):
            good = (sums[k] >= least[k]) & (ids[alive] != query_ids[a + k])
            if good.any():
                b.add(np.rint(sums[k][good]).astype(np.int64), ids[alive][good])


def _search(k: int):
    def run(key, left, right):
        import pandas as pd

        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        block = left.iloc[0]
        query_ids = np.frombuffer(block.ids, np.int64)
        queries = np.frombuffer(block.matrix, np.int64).reshape(block.dim, -1)
        best = [Best(k) for _ in query_ids]
        for row in right.sort_values("block").itertuples():
            search_block(queries, query_ids, best, np.frombuffer(row.matrix, np.int64).reshape(row.dim, -1), np.frombuffer(row.ids, np.int64))
        return pd.DataFrame({"query_id": np.repeat(query_ids, [len(b.ids) for b in best]),
                             "vec_id": np.concatenate([b.ids for b in best]),
                             "score": np.concatenate([b.scores for b in best])})[names]
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for every row of ``is_query``."""
    at = vectors.where(usable(vectors[vector_col]) & vectors[id_col].isNotNull()) \
        .select(vectors[id_col].cast("long").alias("id"), scaled(vectors[vector_col], scale).alias("v"), is_query.alias("q")) \
        .withColumn("dim", F.size("v"))
    asked = at.where("q").select("id", "dim", "v").dropDuplicates(["id"])
    sizes = at.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    blocks, groups = -(-sizes["n"] // BLOCK) or 1, -(-sizes["q"] // QUERIES) or 1
    stripes = -(-blocks // STRIPE)
    left = packed(asked, groups).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = packed(at.select("id", "dim", "v"), blocks).withColumn("stripe", F.pmod("block", F.lit(stripes)).cast("int")) \
        .withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = left.groupBy("dim", "block", "stripe").cogroup(right.groupBy("dim", "to", "stripe")) \
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
