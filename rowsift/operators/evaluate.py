"""Downstream model quality.

Fits are ``pyspark.ml`` jobs; scoring is table work: one conditional-count
aggregate for accuracy / precision / recall / F1 and a rank-sum AUC computed
from per-score counts (pre-aggregated, then range-partitioned running sums), so no
window ever holds a whole (source, classifier) partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.functions.encode import moments, standardise
from rowsift.operators.boosting import DRAWN_ROWS, PLAIN_ROWS, binned_rows, count_binned, fit_boosted, fit_counted, takes_counts
from rowsift.operators.ordered import running
from rowsift.operators.staging import without_summary
from rowsift.session import cut_lineage

KEYS = ("source", "clf")


# ------------------------------------------------------------------ E4
def classifiers(seed: int = 0) -> dict:
    """The four downstream models (boosted trees, forest, logistic regression, decision tree)."""
    return {
        "gbt": GBTClassifier(featuresCol="_f", labelCol="_label", maxIter=100, maxDepth=3, seed=seed),
        "rf": RandomForestClassifier(featuresCol="_f", labelCol="_label", numTrees=100, seed=seed),
        "lr": LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=100),
        "dt": DecisionTreeClassifier(featuresCol="_f", labelCol="_label", seed=seed),
    }


# ------------------------------------------------------------------ E2
def classification_metrics(pred: DataFrame, by: Sequence[str] = KEYS, y: str = "y",
                           y_pred: str = "y_pred", rows: str | None = None) -> DataFrame:
    """accuracy, precision, recall, F1 for label 1 (0 when undefined), one aggregate. ``rows``: a column that tells how
    many rows each one stands for."""
    t, p = F.col(y) == 1, F.col(y_pred) == 1
    times = F.lit(1) if rows is None else F.col(rows)
    number = lambda is_so: F.sum(is_so.cast("long") * times)
    c = pred.groupBy(*by).agg(
        (F.count("*") if rows is None else F.sum(rows)).alias("n"),
        number(t & p).alias("tp"), number(~t & p).alias("fp"), number(t & ~p).alias("fn"), number(~t & ~p).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(*by, "n", "tp", "fp", "fn", "tn",
                    div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


# ------------------------------------------------------------------ E3
def roc_auc(pred: DataFrame, by: Sequence[str] = KEYS, y: str = "y", score: str = "score", y_pred: str = "y_pred",
            rows: str | None = None) -> DataFrame:
    """Rank-sum AUC with ties (= sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)) from integer counts; one class -> 0.
    A row without a score counts with its hard prediction. ``rows``: as in ``classification_metrics``."""
    times = F.lit(1) if rows is None else F.col(rows)
    by = list(by)
    s = F.col(score).cast("double")
    if y_pred in pred.columns:
        s = F.coalesce(s, F.col(y_pred).cast("double"))
    per = pred.where(s.isNotNull()).groupBy(*by, s.alias("_s")).agg(
        F.sum((F.col(y) == 1).cast("long") * times).alias("pos"), F.sum((F.col(y) != 1).cast("long") * times).alias("neg"))
    agg = running(per, by, "_s", ["neg"]).groupBy(*by).agg(
        F.sum(F.col("pos") * (2 * F.col("cum_neg") - F.col("neg"))).alias("_u2"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(0.0))
                      .otherwise(F.col("_u2") / 2 / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


# ------------------------------------------------------------------ E1 / E5
def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, clf,
                keys: Sequence[str] = ("rid",), scale: bool = True) -> DataFrame:
    """Fit one classifier on ``train`` (standardised by train stats), predict ``test``:
    ``(keys..., y, y_pred, score)`` with score = P(class 1)."""
    if scale:
        both = standardise(train.withColumn("_part", F.lit("train")).unionByName(test.withColumn("_part", F.lit("test"))),
                           features, ref=train)
        train, test = both.where(F.col("_part") == "train").drop("_part"), both.where(F.col("_part") == "test").drop("_part")
    labelled = train.withColumn("_label", F.col(label).cast("double"))
    if isinstance(clf, GBTClassifier):
        m = fit_boosted(labelled, features, "_label", clf, "_f")
    else:
        asm = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep")
        m = without_summary(Pipeline(stages=[asm, clf]).fit(labelled))
    out = m.transform(test.withColumn("_label", F.col(label).cast("double")))
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keys, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("y_pred"), score.alias("score"))


def evaluate_model(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, clf) -> DataFrame:
    """Accuracy, recall, precision, F1 and AUC of one classifier."""
    train = cut_lineage(train, "train")  # read by the statistics and by every pass of the fit
    pred = fit_predict(train, test, features, label, clf)
    pred = cut_lineage(pred.select("y", "y_pred", "score"), "predictions").withColumn("source", F.lit("train")).withColumn("clf", F.lit("model"))
    return classification_metrics(pred).join(roc_auc(pred), list(KEYS))


def _predictions_of(m, test: DataFrame, label: str, rows: Column) -> DataFrame:
    """(y, y_pred, score, n) of a fitted model: what the metrics need of the ``n`` rows that each row of ``test`` stands for."""
    out = m.transform(test)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("y_pred"), score.alias("score"), rows.cast("long").alias("n"))


def fit_predict_large(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, clfs: Mapping) -> dict[str, DataFrame]:
    """``fit_predict`` of several classifiers on a large table, as (y, y_pred, score, n) per classifier. Trees see the bins of a
    feature only: they are fitted on the rows counted per combination of bins and label, and score each combination of the
    test rows once. The other classifiers read every row, and so does a forest if there are hardly fewer combinations."""
    stats = cut_lineage(moments(train, features), "moments")
    train = standardise(train.withColumn("_label", F.col(label).cast("double")), features, stats=stats)
    test = standardise(test, features, stats=stats)
    out, binned = {}, {}
    for cname, clf in clfs.items():
        counted = None
        if takes_counts(clf):
            bins = clf.getMaxBins()
            if bins not in binned:
                bucket, found = binned_rows(train, features, "_label", bins)
                binned[bins] = found, found.count(), cut_lineage(count_binned(bucket, test, label), "binned-test")
            counted, n, tested = binned[bins]
        if counted is None or isinstance(clf, RandomForestClassifier) and n > DRAWN_ROWS:
            asm = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep")
            out[cname] = _predictions_of(without_summary(Pipeline(stages=[asm, clf]).fit(train)), test, label, F.lit(1))
        else:
            out[cname] = _predictions_of(fit_counted(counted, clf, "_f"), tested, label, F.col("_weight"))
    return out


def downstream(sources: DataFrame, test: DataFrame, features: Sequence[str], label: str,
               clfs: Mapping | None = None, src: str = "source", keep: bool = True, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """E5: train on every source x classifier (each fit a distributed job), predict the held-out test,
    union the predictions and score them once by ``groupBy``. Sources of more than ``plain_rows`` rows are fitted by
    ``fit_predict_large``. ``keep``: cache both tables, which every fit reads again (not if they come from written ones)."""
    clfs = clfs or classifiers()
    sources, test = sources.select(src, *features, label), test.select(*features, label)
    if keep:
        sources, test = sources.cache(), test.cache()
    sizes = sources.groupBy(src).agg(F.count("*").alias("n")).orderBy(src).collect()  # a row per source
    preds = None
    for name, n in sizes:
        tr, fresh = sources.where(F.col(src) == name).drop(src), {c: clf.copy() for c, clf in clfs.items()}
        if n > plain_rows:
            found = fit_predict_large(tr, test, features, label, fresh)
        else:
            found = {c: fit_predict(tr, test, features, label, clf, keys=()).withColumn("n", F.lit(1).cast("long")) for c, clf in fresh.items()}
        for cname, p in found.items():
            p = p.withColumn("source", F.lit(name)).withColumn("clf", F.lit(cname))
            preds = p if preds is None else preds.unionByName(p)
    preds = cut_lineage(preds, "predictions")  # read twice; every model scores the test once
    return classification_metrics(preds, rows="n").join(roc_auc(preds, rows="n"), list(KEYS))


# ------------------------------------------------------------------ E6
def mean_over_classifiers(metrics: DataFrame, exclude: Sequence[str] = ("dt",),
                          cols: Sequence[str] = ("accuracy", "auc")) -> DataFrame:
    return metrics.where(~F.col("clf").isin(list(exclude))).groupBy("source").agg(*[F.avg(c).alias(c) for c in cols])


def per_classifier(metrics: DataFrame, clfs: Sequence[str], exclude: Sequence[str] = ("dt",),
                   cols: Sequence[str] = ("accuracy", "precision", "recall", "f1", "auc")) -> DataFrame:
    """One row per source and metric: a column per classifier (null where it was not run), and ``mean``, over those
    of them that are not excluded."""
    long = metrics.select("source", "clf", *cols).unpivot(["source", "clf"], list(cols), "metric", "value")
    return long.groupBy("source", "metric").agg(
        *[F.max(F.when(F.col("clf") == c, F.col("value"))).alias(c) for c in clfs],
        F.avg(F.when(F.col("clf").isin([c for c in clfs if c not in exclude]), F.col("value"))).alias("mean"))


# ------------------------------------------------------------------ E7
def oracle_agreement(oracle: DataFrame, sources: DataFrame, features: Sequence[str], label: str,
                     split: str | None = None, nest: int = 100, seed: int = 0) -> DataFrame:
    """Fit boosted trees on the oracle split; accuracy of its predictions against each source's labels."""
    gbt = GBTClassifier(featuresCol="_f", labelCol="_label", maxIter=nest, seed=seed)
    m = fit_boosted(oracle.withColumn("_label", F.col(label).cast("double")), features, "_label", gbt, "_f")
    pred = m.transform(sources)
    by = ["source"] + ([split] if split else [])
    return pred.groupBy(*by).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"),
                                 F.count("*").alias("n"))
