"""Staged tree-ensemble scoring and end-to-end curation.

The reference re-scores the table with the first *i* trees for every
i = 1..nest-1 (O(nest^2) tree evaluations, nest full passes). Here a single
``transform`` of the fitted ``pyspark.ml`` model emits every row's leaf index
per tree (``leafCol``), and the leaf values are a table of their own
(``leaf_values``: step, tree, leaf, value per class). ``fold_leaves`` brings
both together and walks the steps once, keeping the running margins:

* a leaf table of at most ``BROADCAST_LEAVES`` numbers (counted) travels as a
  broadcast variable, and Arrow batches are folded by a vectorised gather and
  cumulative sum: one pass, no shuffle, O(nest) per row;
* a larger one is joined on (tree, leaf), and each row's values are gathered
  again by its row number (at most one entry per tree).

Both give the gold probability after every step for binary boosting
(``logit``), one boosted model per class (``ovr``) and class means of a forest
(``mean``). ``engine="sql"`` is the same fold in higher-order functions.

Trees with continuous splits and at most 64 leaves need no ``transform`` for the
fold: ``leaf_boxes`` writes their splits as bits per feature interval, and the
batch that folds the leaves finds them, too, so that no leaf array crosses to Python.
A training table is written out before a fit, which reads it several times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier,
                                       LogisticRegression, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsift.functions.literals import const_array
from rowsift.operators import dynamics as dyn
from rowsift.operators.boosting import drop_bins, fit_boosted
from rowsift.session import cut_lineage, scratch_path

BROADCAST_LEAVES = 4_000_000  # numbers of a leaf table that is broadcast (32 MB); beyond it the table is joined
KINDS = ("logit", "ovr", "mean")


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


# ------------------------------------------------------------------ K1 / K2
LARGE_TRAIN_ROWS = 1_000_000


def _lineage_opts(train: DataFrame, large: bool | None) -> dict:
    """Node-id caching + periodic checkpoints (to spark.checkpoint.dir) only pay off for large
    training tables; on small trusted samples they double the fit time."""
    if large is None:
        large = train.count() > LARGE_TRAIN_ROWS
    if large:
        from rowsift.session import checkpoint_root
        checkpoint_root(train.sparkSession)
        return {"cacheNodeIds": True, "checkpointInterval": 10}
    return {"cacheNodeIds": False, "checkpointInterval": -1}


def written_train(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """What a fit reads, computed once: each of its passes would run the plan of ``train`` (a sample of a large table) again."""
    return cut_lineage(train.select(*features, label), "train")


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model as saved and loaded: a training summary holds the session and would travel with every task."""
    if not any(getattr(stage, "hasSummary", False) for stage in model.stages):
        return model
    path = scratch_path(SparkSession.getActiveSession(), "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def fit_gbt(train: DataFrame, features: Sequence[str], label: str = "y", nest: int = 100,
            max_depth: int = 6, step: float = 0.3, seed: int = 0,
            subsampling: float = 1.0, large: bool | None = None) -> PipelineModel:
    """Boosted trees on the trusted table (binary labels 0/1)."""
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=nest, maxDepth=max_depth,
                        stepSize=step, seed=seed, subsamplingRate=subsampling,
                        leafCol="_leaf", maxBins=64, **_lineage_opts(train, large))
    return fit_boosted(train, features, label, gbt, "_features")


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "y", nest: int = 100,
               max_depth: int = 6, seed: int = 0, large: bool | None = None) -> PipelineModel:
    """Random forest (multiclass capable) for the averaging stager (K4)."""
    train = written_train(train, features, label)
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=nest,
                                maxDepth=max_depth, seed=seed, leafCol="_leaf", **_lineage_opts(train, large))
    return without_summary(Pipeline(stages=[_assembler(features), rf]).fit(train))


def fit_gbt_per_class(train: DataFrame, features: Sequence[str], label: str, n_classes: int, **options) -> list[PipelineModel]:
    """Boosted trees for labels 0..n_classes-1: one binary model per class (class against the rest)."""
    return [fit_gbt(train.withColumn("_is", (F.col(label) == c).cast("int")), features, "_is", **options) for c in range(n_classes)]


def _tree_model(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


# ------------------------------------------------------------------ leaf table
def leaf_table(model) -> DataFrame:
    """``(tree, leaf, value ARRAY<DOUBLE>)`` of a fitted ensemble, leaves numbered as ``leafCol``.

    Saved node ids are pre-order, so ordering a tree's leaves by id gives the
    left-to-right numbering that ``leafCol`` uses.
    """
    tm = _tree_model(model)
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    tm.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    leaves = nodes.where(F.col("nodeData.leftChild") == -1).select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node_id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("stats"))
    w = Window.partitionBy("tree").orderBy("node_id")  # one tree per window partition (bounded)
    return leaves.select("tree", (F.row_number().over(w) - 1).alias("leaf"), "prediction", "stats")


def leaf_values(model) -> DataFrame:
    """``(step, tree, leaf, value ARRAY<DOUBLE>)`` of a fitted ensemble, or of one boosted model per class.

    ``value`` is what a row in the leaf adds to the running sums: the weighted margin (one number) of binary
    boosting, class shares of a forest, the margin at its class of one model per class. ``step`` is the
    0-based checkpoint from which the tree counts; with one model per class, round r of every class is step r.
    """
    if isinstance(model, (list, tuple)):
        out, first = None, 0
        for c, m in enumerate(model):
            one = leaf_values(m).select("step", (F.col("tree") + first).cast("int").alias("tree"), "leaf", F.array(
                *[F.get("value", F.lit(0)) if k == c else F.lit(0.0) for k in range(len(model))]).alias("value"))
            out, first = one if out is None else out.unionByName(one), first + len(_tree_model(m).trees)
        return out
    tm = _tree_model(model)
    leaves = leaf_table(model).select(F.col("tree").cast("int").alias("step"), F.col("tree").cast("int").alias("tree"), "leaf", "prediction", "stats")
    if isinstance(tm, GBTClassificationModel):
        weight = F.get(const_array(list(tm.treeWeights)), F.col("tree"))
        return leaves.select("step", "tree", "leaf", F.array(F.col("prediction") * weight).alias("value"))
    total = F.aggregate("stats", F.lit(0.0), lambda a, v: a + v)
    share = F.transform("stats", lambda v: v / F.when(total == 0, F.lit(1.0)).otherwise(total))
    return leaves.select("step", "tree", "leaf", share.alias("value"))


def ensemble_kind(model) -> str:
    if isinstance(model, (list, tuple)):
        return "ovr"
    tm = _tree_model(model)
    if isinstance(tm, GBTClassificationModel):
        return "logit"
    if isinstance(tm, RandomForestClassificationModel):
        return "mean"
    raise TypeError("staging supports GBT and random-forest classification models")


def with_leaves(model, df: DataFrame, col: str = "_lf") -> DataFrame:
    """``df`` and the leaf index per tree as an array (the trees of several models one after the other)."""
    models = list(model) if isinstance(model, (list, tuple)) else [model]
    out = df
    for c, m in enumerate(models):
        scored = m.transform(out).withColumn(f"{col}{c}", vector_to_array("_leaf"))
        out = drop_bins(scored).drop("_features", "_leaf", "rawPrediction", "probability", "prediction")
    parts = [f"{col}{c}" for c in range(len(models))]
    return out.withColumn(col, F.transform(F.concat(*parts), lambda v: v.cast("int"))).drop(*parts)


LEAF_BITS = 64  # leaves of a tree that fit one word
BOX_WORDS = 4_000_000  # words of the bit tables that travel to the tasks (32 MB)


class _LeafBoxes:
    """The leaf of each tree from a row's features. A feature's thresholds cut it into intervals; a word per (interval, tree)
    has a bit for every leaf that the interval leaves open, and the words of all features have one bit in common."""

    def __init__(self, columns: list[str], edges: dict, masks: dict, n_trees: int):
        self.columns, self.edges, self.masks, self.n_trees = columns, edges, masks, n_trees

    def leaves(self, x: list):
        """(rows, trees); ``x`` has an array per column. A missing value goes right, as in a tree."""
        import numpy as np

        left = None
        for f, e in self.edges.items():
            found = self.masks[f][np.searchsorted(e, x[f], side="left")]
            left = found if left is None else np.bitwise_and(left, found, out=left)
        if left is None:
            return np.zeros((len(x[0]), self.n_trees), dtype=np.int64)
        return np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # the place of the bit


def _split_nodes(model) -> list:
    """Nodes per tree of a fitted ensemble (the driver holds them anyway): id, children, feature, threshold, kind of split."""
    tm = _tree_model(model)
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree-model")
    tm.write().overwrite().save(path)
    node, split = "nodeData.", "nodeData.split."
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{node}id", f"{node}leftChild", f"{node}rightChild", f"{split}featureIndex",
        F.get(f"{split}leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), f"{split}numCategories").collect()
    trees: list[dict] = [{} for _ in tm.trees]
    for r in rows:
        trees[r["treeID"]][r["id"]] = r
    return trees


def leaf_boxes(model) -> tuple[list, _LeafBoxes] | None:
    """(stages before the assembler, leaf finder) of a fitted ensemble or a list of them; None if it isn't an assembler of
    plain columns before trees of continuous splits and at most ``LEAF_BITS`` leaves."""
    import numpy as np

    models = list(model) if isinstance(model, (list, tuple)) else [model]
    if not all(isinstance(m, PipelineModel) and len(m.stages) > 1 and isinstance(m.stages[-2], VectorAssembler) for m in models):
        return None
    columns = models[0].stages[-2].getInputCols()
    before = models[0].stages[:-2]
    if len(models) > 1 and (before or any(m.stages[:-2] or m.stages[-2].getInputCols() != columns for m in models)):
        return None
    trees = [t for m in models for t in _split_nodes(m)]
    inner = [n for t in trees for n in t.values() if n["leftChild"] >= 0]
    if any(n["numCategories"] != -1 for n in inner) or any(sum(n["leftChild"] < 0 for n in t.values()) > LEAF_BITS for t in trees):
        return None
    edges = {f: np.array(sorted({n["threshold"] for n in inner if n["featureIndex"] == f})) for f in sorted({n["featureIndex"] for n in inner})}
    if any(f >= len(columns) for f in edges) or sum(len(e) + 1 for e in edges.values()) * len(trees) > BOX_WORDS:
        return None
    masks = {f: np.zeros((len(e) + 1, len(trees)), dtype=np.uint64) for f, e in edges.items()}
    for k, tree in enumerate(trees):
        number = 0
        todo = [(0, {f: (0, len(e)) for f, e in edges.items()})]  # node, open intervals; leaves come from left to right
        while todo:
            at, box = todo.pop()
            n = tree[at]
            if n["leftChild"] < 0:
                for f, (low, high) in box.items():
                    masks[f][low:high + 1, k] |= np.uint64(1 << number)
                number += 1
                continue
            f = n["featureIndex"]
            place, (low, high) = int(np.searchsorted(edges[f], n["threshold"])), box[f]
            todo.append((n["rightChild"], {**box, f: (max(low, place + 1), high)}))
            todo.append((n["leftChild"], {**box, f: (low, min(high, place))}))
    return before, _LeafBoxes(columns, edges, masks, len(trees))


# ------------------------------------------------------------------ K3 / K4
_DYN_SCHEMA = ("confidence double, aleatoric double, variability double, correctness double, "
               "entropy double, n_checkpoints long")


class _LeafArrays:
    """A collected leaf table: one row of ``values`` per (tree, leaf), trees in rising step."""

    def __init__(self, rows: list):
        import numpy as np

        rows = sorted(rows, key=lambda r: (r["step"], r["tree"], r["leaf"]))
        self.values = np.array([r["value"] for r in rows], dtype=np.float64)
        tree = np.array([r["tree"] for r in rows], dtype=np.int64)
        leaf = np.array([r["leaf"] for r in rows], dtype=np.int64)
        first = np.concatenate([[True], tree[1:] != tree[:-1]])
        self.trees = tree[first]  # which entry of a row's leaf array
        self.offsets = np.flatnonzero(first) - leaf[first]  # so that offset + leaf is the place
        step = np.array([r["step"] for r in rows], dtype=np.int64)[first]
        self.ends = np.flatnonzero(np.concatenate([step[1:] != step[:-1], [True]]))  # last tree of each step

    def gold(self, leaves, y, kind: str, steps: int):
        """(rows, steps): the probability of label ``y`` after each of the first steps. ``leaves``: (rows, trees)."""
        import numpy as np

        ends = self.ends[:steps]
        last = int(ends[-1]) + 1
        place = self.offsets[:last] + leaves[:, self.trees[:last]]
        if kind == "mean":  # no other class counts
            return np.cumsum(self.values[place, y[:, None]], axis=1)[:, ends] / (ends + 1)[None, :]
        sums = np.cumsum(self.values[place], axis=1)[:, ends]
        if kind == "logit":
            return 1.0 / (1.0 + np.exp(-2.0 * (2 * y[:, None] - 1) * sums[:, :, 0]))
        mine = np.take_along_axis(sums, y[:, None, None], axis=2)[:, :, 0]
        return 1.0 / (1.0 + np.exp(-2.0 * mine)) / (1.0 / (1.0 + np.exp(-2.0 * sums))).sum(axis=2)


def _gold_by_join(rows: DataFrame, leaf: str, label: str, values: DataFrame, kind: str) -> DataFrame:
    """``rows`` and ``_g``, the gold probability after each step, by a join on (tree, leaf)."""
    numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "leaf-rows")
    long = numbered.select("_row", F.posexplode(leaf).alias("_tree", "_leaf_id"))
    held = values.select(F.col("tree").alias("_tree"), F.col("leaf").alias("_leaf_id"), F.col("step").alias("_step"), F.col("value").alias("_value"))
    per_step = long.join(held, ["_tree", "_leaf_id"]).groupBy("_row").agg(  # one entry per tree
        F.sort_array(F.collect_list(F.struct(F.col("_step").alias("s"), F.col("_tree").alias("t"), F.col("_value").alias("v")))).alias("_vs"))
    out = numbered.join(per_step, "_row")
    y = F.col(label).cast("int")
    sigmoid = lambda v: 1 / (1 + F.exp(-2 * v))

    def gold(total, n):
        if kind == "logit":
            return sigmoid((2 * y - 1) * F.get(total, F.lit(0)))
        if kind == "mean":
            return F.get(total, y) / n
        return sigmoid(F.get(total, y)) / F.aggregate(total, F.lit(0.0), lambda a, v: a + sigmoid(v))

    def walk(acc, i):
        one, following = F.get(F.col("_vs"), i), F.get(F.col("_vs"), i + 1)
        total = F.when(i == 0, one["v"]).otherwise(F.zip_with(acc["total"], one["v"], lambda a, b: a + b))
        ends = following["s"].isNull() | (following["s"] != one["s"])
        return F.struct(total.alias("total"), F.when(ends, F.concat(acc["g"], F.array(gold(total, i + 1)))).otherwise(acc["g"]).alias("g"))

    empty = F.array().cast("array<double>")
    folded = F.aggregate(F.sequence(F.lit(0), F.size("_vs") - 1), F.struct(empty.alias("total"), empty.alias("g")), walk, lambda acc: acc["g"])
    return out.withColumn("_g", folded).drop("_row", "_vs")


def fold_leaves(rows: DataFrame, values: DataFrame, kind: str, leaf: str | _LeafBoxes = "_lf", label: str = "y", include_last: bool = False,
                history: bool = False, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """``rows`` (without ``leaf``) and the dynamics of the gold probability over the steps of a leaf table; with ``history`` the
    probabilities themselves (``p``). The last step is left out unless ``include_last``.

    ``rows`` holds a leaf index per tree (``leaf``), or the columns from which ``leaf`` finds it, and the label; ``values`` is a
    table as ``leaf_values`` gives it."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; use one of {KINDS}")
    values = cut_lineage(values, "leaf-values")
    size = values.agg(F.coalesce(F.sum(F.size("value")), F.lit(0)).alias("n"), F.countDistinct("step").alias("steps")).first()
    steps = size["steps"] - (0 if include_last else 1)
    if steps < 1:
        raise ValueError("need at least two trees (checkpoints stop at nest - 1)")
    context, boxes = rows.sparkSession.sparkContext, None
    if isinstance(leaf, _LeafBoxes):
        boxes, given = context.broadcast(leaf), [F.col(c).cast("double") for c in leaf.columns]
        keep = rows.columns
        if size["n"] > broadcast_leaves:
            rows, leaf = rows.withColumn("_lf", _batch_udf(_box_batches(boxes), "array<int>")(*given)), "_lf"
    else:
        given, keep = [F.col(leaf)], [c for c in rows.columns if c != leaf]
    if size["n"] > broadcast_leaves:
        out = _gold_by_join(rows, leaf, label, values, kind).withColumn("_g", F.slice("_g", 1, steps))
        if history:
            return out.select(*keep, F.col("_g").alias("p"))
        return dyn.wide_dynamics(out.select(*keep, "_g"), "_g").select(*keep, *dyn.METRIC_COLUMNS, "n_checkpoints")
    shared = context.broadcast(_LeafArrays(values.collect()))  # at most ``broadcast_leaves`` numbers
    udf = _batch_udf(_fold_batches(shared, kind, steps, history, boxes), "array<double>" if history else _DYN_SCHEMA)
    out = rows.select(*keep, udf(*given, F.col(label)).alias("_d"))
    return out.select(*keep, F.col("_d").alias("p")) if history else out.select(*keep, "_d.*")


def _batch_udf(fn, schema: str):
    import warnings

    from pyspark.sql.functions import PandasUDFType, pandas_udf
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pandas_udf(fn, schema, PandasUDFType.SCALAR)


def _box_batches(boxes):
    import numpy as np
    import pandas as pd

    def fn(*columns):
        return pd.Series(list(boxes.value.leaves([c.to_numpy(dtype=np.float64) for c in columns]).astype(np.int32)), dtype=object)

    return fn


FOLD_ROWS = 1024  # rows folded at once, so that their numbers stay in a core's cache


def _fold_batches(shared, kind: str, steps: int, history: bool, boxes=None):
    import numpy as np
    import pandas as pd

    names = [c.split()[0] for c in _DYN_SCHEMA.split(", ")]

    def fn(*columns):  # (leaves or features..., labels) -> pd.DataFrame or pd.Series of arrays
        n = len(columns[-1])
        if n == 0:
            return pd.Series([], dtype=object) if history else pd.DataFrame({c: [] for c in names})
        y = columns[-1].to_numpy().astype(np.int64)
        if boxes is None:
            leaf = np.stack(columns[0].to_numpy()).astype(np.int64)
        else:
            x = [c.to_numpy(dtype=np.float64) for c in columns[:-1]]
        parts = []
        for s in range(0, n, FOLD_ROWS):
            at = slice(s, min(n, s + FOLD_ROWS))
            g = shared.value.gold(leaf[at] if boxes is None else boxes.value.leaves([v[at] for v in x]), y[at], kind, steps)
            parts.append(list(g) if history else (g.mean(axis=1), (g * (1 - g)).mean(axis=1), g.std(axis=1), (g > 0.5).mean(axis=1),
                                                  -(g * np.log(g + dyn.EPS)).sum(axis=1), np.full(len(g), g.shape[1], dtype=np.int64)))
        if history:
            return pd.Series([row for part in parts for row in part])
        return pd.DataFrame({c: np.concatenate(found) for c, found in zip(names, zip(*parts, strict=True), strict=True)})

    return fn


def _fold_model(model, df: DataFrame, label: str, include_last: bool, history: bool = False) -> DataFrame:
    found = leaf_boxes(model)
    if found is None:
        return fold_leaves(with_leaves(model, df), leaf_values(model), ensemble_kind(model), "_lf", label, include_last, history)
    before, boxes = found
    rows = PipelineModel(before).transform(df) if before else df
    out = fold_leaves(rows, leaf_values(model), ensemble_kind(model), boxes, label, include_last, history)
    return drop_bins(out) if before else out


def staged_dynamics(model, df: DataFrame, label: str = "y", include_last: bool = False, engine: str = "numpy") -> DataFrame:
    """Per-row dynamics over checkpoints i = 1..nest-1 (or nest) in one pass.

    Boosted trees: p_i = sigmoid(2 * sum_{t<i} w_t * leaf_t), gold = p or 1-p; one model per class (a list): the
    sigmoid of the label's margin over the sum of all classes' sigmoids. Random forest (K4): p_i = mean_{t<i} leaf
    class-probability of the label, any number of classes.

    ``engine='sql'`` is the higher-order-function version of one model (no Python worker, the leaf table as a literal).
    """
    if engine == "sql":
        return _dynamics_in_sql(model, df, label, include_last)
    return _fold_model(model, df, label, include_last)


def _dynamics_in_sql(model, df: DataFrame, label: str, include_last: bool) -> DataFrame:
    boost = ensemble_kind(model) == "logit"
    rows = leaf_values(model).orderBy("tree", "leaf").collect()  # the leaves of a model that the driver holds anyway
    width, n_trees = len(rows[0]["value"]), rows[-1]["tree"] + 1
    offsets = [0] * n_trees
    for k in reversed(range(len(rows))):
        offsets[rows[k]["tree"]] = k * width
    steps = n_trees if include_last else n_trees - 1
    flat_lit, off_lit = const_array([v for r in rows for v in r["value"]]), const_array(offsets, "int")
    y = F.col(label).cast("int")

    def contrib(t):
        place = F.element_at(off_lit, t + 1) + F.element_at(F.col("_lf"), t + 1) * width
        return F.element_at(flat_lit, place + (F.lit(0) if boost else y) + 1)

    def walk(acc, t):
        total = acc["F"] + contrib(t)
        g = 1 / (1 + F.exp(-2 * (2 * y - 1) * total)) if boost else total / (t + 1)
        return F.struct(total.alias("F"), (acc["s1"] + g).alias("s1"), (acc["s2"] + g * g).alias("s2"), (acc["sq"] + g * (1 - g)).alias("sq"),
                        (acc["sc"] + (g > 0.5).cast("double")).alias("sc"), (acc["se"] + g * F.log(g + F.lit(dyn.EPS))).alias("se"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("F", "s1", "s2", "sq", "sc", "se")])
    folded = with_leaves(model, df).withColumn("_s", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, walk))
    n, conf = float(steps), F.col("_s.s1") / float(steps)
    return folded.select(*df.columns, conf.alias("confidence"), (F.col("_s.sq") / n).alias("aleatoric"),
                         F.sqrt(F.greatest(F.col("_s.s2") / n - conf * conf, F.lit(0.0))).alias("variability"),
                         (F.col("_s.sc") / n).alias("correctness"), (-F.col("_s.se")).alias("entropy"),
                         F.lit(steps).cast("long").alias("n_checkpoints"))


def staged_probabilities(model, df: DataFrame, label: str = "y", include_last: bool = False) -> DataFrame:
    """K8 accessor: the gold-label history as ``p ARRAY<DOUBLE>``."""
    return _fold_model(model, df, label, include_last, history=True)


# ------------------------------------------------------------------ K5
def epoch_refit_history(train: DataFrame, check: DataFrame, features: Sequence[str],
                        label: str = "y", epochs: Sequence[int] = (1, 2, 3, 5, 8),
                        keys: Sequence[str] = ("rid",)) -> DataFrame:
    """Non-staged scoring: refit a logistic regression with maxIter=e per checkpoint.

    Returns the long table ``(keys..., label, checkpoint, p)`` for ``dynamics_groups``.
    """
    train = written_train(train, features, label)
    scored = _assembler(features).transform(check.select(*dict.fromkeys([*keys, label, *features])))
    for i, e in enumerate(epochs, start=1):
        lr = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=int(e), probabilityCol=f"_pr{i}",
                                rawPredictionCol=f"_raw{i}", predictionCol=f"_label{i}")
        fitted = without_summary(Pipeline(stages=[_assembler(features), lr]).fit(train))
        scored = fitted.stages[-1].transform(scored)
    gold = F.array(*[dyn.gold_probability(vector_to_array(f"_pr{i}"), F.col(label)) for i in range(1, len(epochs) + 1)])
    return dyn.explode_history(scored.select(*keys, label, gold.alias("p")))  # one pass over the rows for all epochs


# ------------------------------------------------------------------ K18 / K20
def curate(train: DataFrame, check: DataFrame, features: Sequence[str], label: str = "y",
           metric: str = "aleatoric", retrain: bool = False, nest: int = 100,
           ythresh: float = 0.2, xthresh: float = 0.2, by: Sequence[str] = ("source",),
           max_depth: int = 6, seed: int = 0, model=None) -> DataFrame:
    """Fit on the trusted table (or on ``check`` when ``retrain``), score every
    row of ``check`` by its staged dynamics and assign easy / ambig / hard.

    ``check`` may hold many sources (column ``source``): one fit, one pass;
    ``mi`` and the adaptive threshold are computed per ``by`` group (K20).
    """
    by = [b for b in by if b in check.columns]
    if model is None:
        model = fit_gbt(check if retrain else train, features, label, nest=nest,
                        max_depth=max_depth, seed=seed)
    # the per-row scores feed the row output *and* the per-source scalars (mi, adaptive
    # threshold): cut the lineage once (reliable checkpoint in the shared folder) so the
    # model pass is not recomputed for each consumer
    scored = cut_lineage(staged_dynamics(model, check, label))
    scored = dyn.add_mi(scored, by)
    return dyn.assign_groups(scored, metric, ythresh, xthresh, by)
