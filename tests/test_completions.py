import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from rowsift.operators import clean as cl
from rowsift.operators import completions as cp
from rowsift.operators.report import deep_dive

SCHEMA = StructType([StructField("a", LongType()), StructField("b", DoubleType()), StructField("c", StringType())])


def _parsed(spark, texts, policy="completion"):
    df = spark.createDataFrame([("s", 0, i, t) for i, t in enumerate(texts)], "source string, iter int, choice int, text string")
    return cp.parse_completions(df, policy=policy)


def test_bad_fragment_discards_completion(spark):
    texts = ['rows {"a": 1} and {"a": 2}', 'rows {"a": 1} {\'a\': 2}', 'broken {"a": } {"a": 3}']
    p = _parsed(spark, texts)
    assert sorted(r["choice"] for r in p.collect()) == [0, 0]
    assert _parsed(spark, texts, "per_fragment").count() == 4


def test_conform_cell_rules(spark):
    texts = ['{"a": 3, "b": 1.5, "c": "x"}',        # ok
             '{"a": 3.7, "b": "2.5", "c": "y"}',    # number truncates, numeric string ok
             '{"a": "3.7", "b": 1, "c": "z"}',      # int string with fraction: strict reject
             '{"a": "4", "b": null, "c": "w"}',     # int string ok, null float kept
             '{"a": null, "b": 1, "c": "v"}',       # null int: reject
             '{"a": true, "b": 2, "c": "u"}',       # bool -> 1
             '{"a": "abc", "b": 2, "c": "t"}',      # reject
             '{"a": 1, "b": [1, 2], "c": "s"}']     # list cell: removed
    good, rej = cl.conform(_parsed(spark, ["\n".join(texts)]), SCHEMA, keep=["frag_pos"])
    got = {r["frag_pos"]: (r["a"], r["b"], r["c"]) for r in good.collect()}
    assert got == {0: (3, 1.5, "x"), 1: (3, 2.5, "y"), 3: (4, None, "w"), 5: (1, 2.0, "u")}
    assert {r["frag_pos"]: r["reject_column"] for r in rej.collect()} == {2: "a", 4: "a", 6: "a"}
    coerce, _ = cl.conform(_parsed(spark, ["\n".join(texts)]), SCHEMA, int_strings="coerce", keep=["frag_pos"])
    assert {r["frag_pos"]: r["a"] for r in coerce.collect()}[2] == 3


def test_placeholders(spark):
    texts = ['{"a": 1, "b": 2, "c": "integer"}', '{"a": 1, "b": 2, "c": "Yes", "x": 1}', '{"a": 1, "b": 2, "c": "ok"}']
    p = _parsed(spark, ["\n".join(texts)])
    assert cl.drop_placeholders(p, cl.PLACEHOLDERS_PARSE).count() == 2
    assert cl.drop_placeholders(p, cl.PLACEHOLDERS_CLEAN).count() == 1


def test_quota_cut_and_reaccumulate(spark):
    rows = spark.createDataFrame([("s", it) for it in range(5) for _ in range(3)], "source string, iter int")
    kept = cp.quota_cut(rows, 7)  # rounds 0,1,2 (cum 3, 6, 9): the first round reaching 7 is included
    assert sorted({r["iter"] for r in kept.collect()}) == [0, 1, 2]
    counts = {r["round"]: r["n_rows"] for r in cp.reaccumulated_counts(rows).collect()}
    assert counts == {0: 3, 1: 6, 2: 9, 3: 12, 4: 15}


def test_together_and_llama_presets(spark):
    schema = StructType([StructField("feat_0", LongType()), StructField("target", LongType())])
    texts = ['{"feat_0": 1, "target": null, "y": 7}', '{"feat_0": 2, "y": "8", "note": "Yes"}',  # a placeholder and a list outside the target
             '{"feat_0": 3, "target": 5, "y": "Yes", "more": [1]}', '{"feat_0": 4, "y": "No"}',       # filled by a placeholder: gone
             '{"feat_0": 5}', '{"feat_0": [6], "target": 1}']
    got = cl.clean_generated(_parsed(spark, ["\n".join(texts)]), schema, "together", original=["age", "salary"])
    assert got.columns[-2:] == ["age", "salary"] and sorted((r["age"], r["salary"]) for r in got.collect()) == [(1, 7), (2, 8), (3, 5)]
    schema = StructType([StructField("sex", LongType()), StructField("target", LongType())])
    texts = ['{"sex": "Male", "target": 30000}', '{"sex": "Female", "target": "50000"}', '{"sex": "Male", "target": 1}',
             '{"sex": ["Male"], "target": 1}', '{"sex": "other", "target": 1}', '{"sex": "Male", "target": "rich"}', '{"sex": "Male", "target": "NaN"}']
    repairs = {"sex": {"Male": 1, "Female": 0}, "target": "label"}
    got = cl.clean_generated(_parsed(spark, ["\n".join(texts)]), schema, "llama", repairs=repairs)
    assert sorted((r["sex"], r["target"]) for r in got.collect()) == [(0, 1), (1, 0), (1, 1)]
    for bad in ({"repairs": repairs}, {"original": ["one"]}):
        with pytest.raises(ValueError):
            cl.clean_generated(_parsed(spark, texts), schema, "together", **bad)


def test_generation_hook(spark):
    """The user's callable gets each prompt once per choice, in batches, and its texts are parsed like any other."""
    def echo(pdf):
        texts = ["Sure:\n" + d.replace("},{", "}\n{").strip("[]") for d in pdf["data"]]
        return pd.DataFrame({"source": pdf["source"].astype(str), "iter": pdf["iter"].astype("int32"), "choice": pdf["choice"].astype("int32"), "text": texts})

    rows = spark.createDataFrame([(i, i * 10 + d) for i in range(3) for d in range(4)], "iter int, a long")
    prompts = cp.build_prompts(cp.serialise_records(rows, ["iter"], ["a"]), instructions="Make more rows.").withColumn("source", F.lit("echo"))
    got = cp.to_columns(cp.parse_completions(cp.generate(prompts, echo, n=2)), ["a"])
    assert sorted((r["iter"], r["choice"], int(r["a"])) for r in got.collect()) == [(i, c, i * 10 + d) for i in range(3) for c in range(2) for d in range(4)]


def test_deep_dive(spark):
    """Seeds beyond two deviations leave the mean, not the ranges; cells are ordered as text; one seed has no error."""
    rows = [(i, "a", 10 + i, 1, 0.5) for i in range(9)] + [(9, "a", 99, 1, 50.0), (0, "b", 1, 2, 0.06), (1, "b", 3, 4, 0.06), (0, "c", 5, 5, 0.9)]
    got = deep_dive(spark.createDataFrame(rows, "seed int, subgroup string, n_orig int, n_gen int, gain double"), k=2).collect()
    assert [tuple(r) for r in got] == [("c", "90.0+-nan", 5, 5, 5, 5), ("b", "6.0+-0.0", 1, 3, 2, 4)]
    got = deep_dive(spark.createDataFrame(rows, "seed int, subgroup string, n_orig int, n_gen int, gain double"), k=9).collect()
    assert tuple(got[2]) == ("a", "50.0+-0.0", 10, 99, 1, 1)


def test_cells_and_fragments_are_computed_once(spark):
    """The plan names each parse and each cell's type once, whatever is asked of them, and rejects only what doesn't convert."""
    texts = ['{"a": 1, "b": "2.5", "c": "x"} {"a": "7", "b": null}', '{"a": true, "b": [1]}', "none", '{"a": "no", "b": 1}', '{"a": {"k": 1}, "b": false, "c": 1.50}']
    good, bad = cl.conform(_parsed(spark, texts), SCHEMA, int_strings="coerce", keep=["choice", "frag_pos"])
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("parseJson") == 1
    assert plan.count("schemaOfVariant(") <= 1 + len(SCHEMA.fields)  # the list test and one per cell
    assert sorted(map(tuple, good.collect())) == [(0, 0, 1, 2.5, "x"), (0, 1, 7, None, None)]
    assert sorted(map(tuple, bad.collect())) == [(3, 0, "a"), (4, 0, "a")]
