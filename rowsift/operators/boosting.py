"""Trees on binned rows.

A tree learner sees only the bin of a feature, so rows of equal bins and label are interchangeable: a large training
table is counted per combination of bins and label once, by one shuffle, and every one of the hundreds of passes of
the fit reads the counts as weights. All rows count; a fit's passes grow with the combinations, not with the rows.

Up to ``PLAIN_ROWS`` rows the table is fitted as it is. Spark takes its candidate splits from a sample of about 10,000
rows; beyond ``PLAIN_ROWS`` they are quantiles of every row (all values of a feature with few of them), so the
candidates don't depend on a sample, and a model may differ from Spark's by them alone.

A forest draws each row so many times for each tree, by a Poisson law of mean 1. Its trees are fitted one by one on the
counts: a combination of n rows is drawn by a Poisson law of mean n, as the sum of its rows would be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.session import cut_lineage

PLAIN_ROWS = 200_000
QUANTILE_ERROR = 0.0005


def thresholds(train: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 rising values, at each of which rows up to it go one way: all values but the
    largest of a feature of up to ``bins`` values, quantiles of the others."""
    out, many = {}, []
    for c in features:
        v = F.col(c).cast("double")
        found = train.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).distinct().limit(bins + 1).collect()  # bins + 1 rows
        if len(found) > bins:
            many.append(c)
        else:
            out[c] = sorted(r["v"] for r in found)[:-1]
    if many:
        shares = [k / bins for k in range(1, bins)]
        as_double = train.select(*[F.col(c).cast("double").alias(c) for c in many])
        for c, found in zip(many, as_double.approxQuantile(many, shares, QUANTILE_ERROR), strict=True):
            out[c] = sorted(set(found))
    return [out[c] for c in features]


def _assemble(cols: Sequence[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="keep")


def _places(features: Sequence[str]) -> list[str]:
    return [f"_bin_{k}" for k in range(len(features))]


def binned_rows(train: DataFrame, features: Sequence[str], label: str, bins: int) -> tuple[Bucketizer, DataFrame]:
    """(what puts ``features`` in ``_bin_<k>`` columns, rows of ``train`` per combination of bins and label as ``_weight``)."""
    edges = thresholds(train, features, bins)
    splits = [[-math.inf, *[math.nextafter(t, math.inf) for t in ts or [0.0]], math.inf] for ts in edges]
    places = _places(features)
    bucket = Bucketizer(inputCols=list(features), outputCols=places, splitsArray=splits, handleInvalid="keep")  # a missing value goes right, as in a tree
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)
    whole = {c: F.when(odd(F.col(c).cast("double")), F.raise_error(F.lit(f"{c} MUST NOT be NaN or Infinity"))).otherwise(F.col(c).cast("double"))
             for c in features}  # as the plain fit
    counted = count_binned(bucket, train.withColumns(whole), label)
    slices = train.sparkSession.sparkContext.defaultParallelism
    return bucket, cut_lineage(counted.repartition(slices, *places), "binned-rows")


def count_binned(bucket: Bucketizer, df: DataFrame, label: str) -> DataFrame:
    places = bucket.getOutputCols()
    binned = bucket.transform(df)
    for c in places:
        binned = binned.withMetadata(c, {})  # a bin is a number with an order, not a category
    return binned.groupBy(*places, label).agg(F.count("*").cast("double").alias("_weight"))


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, gbt: GBTClassifier, output: str, plain_rows: int = PLAIN_ROWS) -> PipelineModel:
    """``gbt`` fitted on all rows of ``train``; the model takes ``features`` and adds ``output`` and ``_bin_<k>`` columns."""
    if not takes_counts(gbt) or train.count() <= plain_rows:
        return Pipeline(stages=[_assemble(features, output), gbt]).fit(train)
    bucket, counted = binned_rows(train, features, label, gbt.getMaxBins())
    return PipelineModel([bucket, *fit_counted(counted, gbt, output).stages])


def takes_counts(clf) -> bool:
    """Whether rows of equal bins and label are interchangeable to ``clf``, so that their count says all about them."""
    if not isinstance(clf, GBTClassifier | RandomForestClassifier | DecisionTreeClassifier):
        return False
    if clf.getMinInstancesPerNode() != 1 or clf.isDefined("weightCol"):
        return False
    return isinstance(clf, DecisionTreeClassifier) or clf.getSubsamplingRate() == 1.0 and not (clf.hasParam("validationIndicatorCol") and clf.isDefined("validationIndicatorCol"))


def fit_counted(counted: DataFrame, clf, output: str) -> PipelineModel:
    """``clf`` fitted on the counts of ``binned_rows``; the model takes ``_bin_<k>`` columns."""
    places = [c for c in counted.columns if c.startswith("_bin_")]
    assemble = _assemble(places, output)
    if isinstance(clf, RandomForestClassifier) and clf.getBootstrap() and clf.getNumTrees() > 1:
        return PipelineModel([assemble, _fit_forest(assemble.transform(_drawn(counted, places, clf)), clf, len(places))])
    return Pipeline(stages=[assemble, clf.copy({clf.weightCol: "_weight"})]).fit(counted)


def _drawn(counted: DataFrame, places: Sequence[str], rf: RandomForestClassifier) -> DataFrame:
    """``counted`` with a column ``_drawn_<tree>`` for each tree: how often the combination's rows are drawn for it, replayable."""
    trees, seed, label = rf.getNumTrees(), rf.getSeed() % 2 ** 63, rf.getLabelCol()
    names = [f"_drawn_{k}" for k in range(trees)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf[[*places, label]].to_numpy(np.int64)
            times = [np.random.default_rng([seed, *key]).poisson(n, trees) for key, n in zip(keys, pdf["_weight"], strict=True)]
            yield pd.concat([pdf[[*places, label]], pd.DataFrame(np.array(times, dtype=float).reshape(len(pdf), trees), columns=names)], axis=1)

    kinds = ", ".join(f"{c} double" for c in [*places, label, *names])
    return cut_lineage(counted.withColumn(label, F.col(label).cast("double")).mapInPandas(draw, kinds), "drawn-rows")


FITS_AT_ONCE = 8
DRAWN_ROWS = 2_000_000  # combinations of which a forest's draws are written, a number for each tree


def _fit_forest(drawn: DataFrame, rf: RandomForestClassifier, n_features: int) -> RandomForestClassificationModel:
    """The trees of ``rf`` fitted one by one, each on its own draws and with a seed of its own, as one model."""
    among = "sqrt" if rf.getFeatureSubsetStrategy() == "auto" else rf.getFeatureSubsetStrategy()
    features, label = rf.getFeaturesCol(), rf.getLabelCol()
    classes = int(drawn.agg(F.max(label)).first()[0]) + 1
    drawn = drawn.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": classes}})  # a tree may draw none of a class

    def fit(k: int):
        rows = drawn.select(features, label, f"_drawn_{k}").where(F.col(f"_drawn_{k}") > 0)
        one = rf.copy({rf.numTrees: 1, rf.bootstrap: False, rf.featureSubsetStrategy: among, rf.seed: rf.getSeed() + k, rf.weightCol: f"_drawn_{k}"})
        return one.fit(rows)

    with ThreadPool(FITS_AT_ONCE) as pool:  # small jobs, which leave cores idle one by one
        trees = pool.map(inheritable_thread_target(drawn.sparkSession)(fit), range(rf.getNumTrees()), chunksize=1)
    kinds, gateway = drawn.sparkSession._jvm.org.apache.spark.ml.classification, drawn.sparkSession.sparkContext._gateway
    found = gateway.new_array(kinds.DecisionTreeClassificationModel, len(trees))
    for k, tree in enumerate(trees):
        found[k] = tree._java_obj.trees()[0]
    forest = RandomForestClassificationModel(kinds.RandomForestClassificationModel(rf.uid, found, n_features, classes))
    return forest.setFeaturesCol(features)


def drop_bins(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_bin_")])
