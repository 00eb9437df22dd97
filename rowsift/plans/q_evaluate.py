"""Checked queries for downstream evaluation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from rowsift.operators import evaluate as ev
from rowsift.operators import sampling as smp
from rowsift.plans.catalog import r6, register
from rowsift.session import scratch_path
from rowsift.sources import fixtures as fx

F7 = fx.F7_SQL


@register("e2_classification_metrics", f"""
SELECT source, clf, n, tp, fp, fn, tn,
       round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT source, clf, count(*) AS n,
             CAST(sum(CASE WHEN y = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN y <> 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN y = 1 AND y_pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN y <> 1 AND y_pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
      FROM ({F7}) f7 GROUP BY source, clf) c""")
def e2_classification_metrics(spark, sf):
    m = ev.classification_metrics(fx.predictions(spark, sf))
    return m.select("source", "clf", "n", "tp", "fp", "fn", "tn",
                    *[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


_AUC_SQL = f"""
WITH s AS (SELECT source, clf, score, sum(CAST(y = 1 AS DOUBLE)) AS pos, sum(CAST(y <> 1 AS DOUBLE)) AS neg
           FROM ({F7}) f7 GROUP BY source, clf, score),
c AS (SELECT *, sum(neg) OVER (PARTITION BY source, clf ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s)
SELECT source, clf, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0
                         ELSE sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)) END AS auc
FROM c GROUP BY source, clf"""


@register("e3_roc_auc", f"SELECT source, clf, round(auc, 6) AS auc FROM ({_AUC_SQL}) a")
def e3_roc_auc(spark, sf):
    return ev.roc_auc(fx.predictions(spark, sf)).select("source", "clf", r6("auc"))


@register("e6_mean_over_classifiers", f"""
WITH m AS (SELECT source, clf, CAST(sum(CASE WHEN y = y_pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy
           FROM ({F7}) f7 GROUP BY source, clf),
a AS ({_AUC_SQL})
SELECT m.source, round(avg(m.accuracy), 6) AS accuracy, round(avg(a.auc), 6) AS auc
FROM m JOIN a ON m.source = a.source AND m.clf = a.clf WHERE m.clf <> 'dt' GROUP BY m.source""")
def e6_mean_over_classifiers(spark, sf):
    p = fx.predictions(spark, sf)
    m = ev.classification_metrics(p).join(ev.roc_auc(p), ["source", "clf"])
    return ev.mean_over_classifiers(m).select("source", r6("accuracy"), r6("auc"))


CLFS = ("gbt", "rf", "lr", "dt")
_METRICS_SQL = f"""
SELECT m.source, m.clf, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, auc
FROM (SELECT source, clf, CAST(count(*) AS DOUBLE) AS n,
             CAST(count(*) FILTER (y = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> 1 AND y_pred = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (y = 1 AND y_pred <> 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (y <> 1 AND y_pred <> 1) AS DOUBLE) AS tn
      FROM ({F7}) f7 GROUP BY source, clf) m JOIN ({_AUC_SQL}) a ON a.source = m.source AND a.clf = m.clf"""


@register("e6_per_classifier", f"""
SELECT source, metric, {', '.join(f"round(max(v) FILTER (clf = '{c}'), 6) AS {c}" for c in CLFS)},
       round(avg(v) FILTER (clf <> 'dt'), 6) AS mean
FROM (UNPIVOT ({_METRICS_SQL}) ON accuracy, precision, recall, f1, auc INTO NAME metric VALUE v) u GROUP BY source, metric""")
def e6_per_classifier(spark, sf):
    p = fx.predictions(spark, sf)
    m = ev.classification_metrics(p).join(ev.roc_auc(p), ["source", "clf"])
    return ev.per_classifier(m, CLFS).select("source", "metric", *[r6(c) for c in (*CLFS, "mean")])


def _split(spark, sf):
    f1 = fx.labelled(spark, sf)
    roles = smp.assign_roles(f1, "y", 100, "rid", seed=42)
    return roles


@register("e1_evaluate_model")
def e1_evaluate_model(spark, sf):
    roles = _split(spark, sf)
    lr = LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=50)
    out = ev.evaluate_model(roles.where(F.col("role") == "original"), roles.where(F.col("role") == "test"),
                            fx.FEATURES, "y", lr)
    return out.select("n", *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


WRITTEN_ROWS = 1_000_000  # beyond it the rows of E5 are hashed once and written; below, a cache does


@register("e5_downstream_sources")
def e5_downstream_sources(spark, sf):
    """Train every source x four classifiers, test on the held-out rows (E4 + E5 + E6)."""
    f4 = fx.real_syn(spark, sf).withColumn("_test", F.substring(F.md5(F.concat("rid", F.lit("|t"))), 1, 1) < "4")
    if large := f4.count() > WRITTEN_ROWS:
        f4, path = f4.drop("rid"), scratch_path(spark, "real-syn")
        f4.write.partitionBy("_test", "source").parquet(path)  # a fit reads the rows of its source alone
        f4 = spark.read.schema(f4.schema).parquet(path)
    m = ev.downstream(f4.where(~F.col("_test")), f4.where("_test"), fx.FEATURES, "y", keep=not large)
    return ev.mean_over_classifiers(m).select("source", r6("accuracy"), r6("auc"))


@register("e7_oracle_agreement")
def e7_oracle_agreement(spark, sf):
    roles = _split(spark, sf)
    f4 = fx.real_syn(spark, sf)
    return ev.oracle_agreement(roles.where(F.col("role") == "oracle"), f4, fx.FEATURES, "y")
