import __spark_entry__ as ent
from rowsift.operators import staging
from rowsift.sources import fixtures as fx
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tests.conftest import SF_TINY


def test_registry_shapes():
    qs, sql = ent.queries(), ent.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"grp", "flip", "n_rows", "avg_confidence"}
    by = {(r["grp"], r["flip"]): r["n_rows"] for r in rows}
    flips_hard = by.get(("hard", 1), 0) / max(1, sum(v for (g, f), v in by.items() if f == 1))
    clean_hard = by.get(("hard", 0), 0) / max(1, sum(v for (g, f), v in by.items() if f == 0))
    assert flips_hard > clean_hard  # mislabelled rows land in hard far more often


def test_staged_last_checkpoint_equals_model_probability(spark):
    df = fx.labelled(spark, SF_TINY).dropDuplicates(["rid"])
    m = staging.fit_gbt(df, fx.FEATURES, "y", nest=5, max_depth=3)
    p = staging.staged_probabilities(m, df, "y", include_last=True)
    ref = m.transform(df).select("rid", vector_to_array("probability")[1].alias("p1"), F.col("y").alias("yy"))
    j = p.join(ref, "rid").select(F.abs(F.element_at("p", -1) - F.when(F.col("yy") == 1, F.col("p1")).otherwise(1 - F.col("p1"))).alias("e"))
    assert j.agg(F.max("e")).first()[0] < 1e-9


def test_some_oracles_at_tiny_scale(spark):
    import duckdb
    con = duckdb.connect()
    for t in ["lineitem", "orders", "events", "customer", "nation", "part", "documents", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    qs, sqls = ent.queries(), ent.oracle_sql()
    for name in ["k21_dynamics_groups", "d1_stratified_sample", "e3_roc_auc", "r5_mean_sem", "p12_nominal_codes",
                 "c5_conform_strict"]:
        a = qs[name](spark, SF_TINY).toPandas()
        b = con.execute(sqls[name]).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        a = a[cols].astype(str).sort_values(cols).reset_index(drop=True)
        b = b[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert a.equals(b), name


def test_numpy_and_sql_stagers_agree(spark):
    df = fx.labelled(spark, SF_TINY).dropDuplicates(["rid"])
    for fit in (staging.fit_gbt, staging.fit_forest):
        m = fit(df, fx.FEATURES, "y", nest=6, max_depth=3)
        a = staging.staged_dynamics(m, df, "y", engine="numpy")
        b = staging.staged_dynamics(m, df, "y", engine="sql").select("rid", *[F.col(c).alias("s_" + c) for c in
                                                                              ("confidence", "aleatoric", "variability", "entropy")])
        j = a.join(b, "rid")
        for c in ("confidence", "aleatoric", "variability", "entropy"):
            assert j.agg(F.max(F.abs(F.col(c) - F.col("s_" + c)))).first()[0] < 1e-9
