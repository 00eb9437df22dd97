"""Literal rows through the data set encodings and a registered file."""

import pytest

from rowsift.sources import registry as rg

COLUMNS = ["age", "workclass", "education", "marital-status", "occupation", "relationship", "race", "sex", "capital-gain",
           "capital-loss", "country", "salary"]


def test_adult_encoding(spark, tmp_path):
    rows = [
        (39, " State-gov", " HS", " Never-married", " Sales", " Own-child", " Black", " Male", 2174, 0, " United-States", " <=50K"),
        (50, " Self-emp-inc", " HS", " Married-civ-spouse", " Sales", " Husband", " White", " Female", 0, 7, " Cuba", " >50K"),
        (28, " Without-pay", " HS", " Unknown", " Sales", " Wife", " Other", " Female", 0, 0, " ?", " >50K"),
        (28, " Without-pay", " HS", " Unknown", " Sales", " Wife", " Other", " Female", 0, 0, " India", " >50K"),
        (28, " Private", None, " Divorced", " Sales", " Wife", " Other", " Female", 0, 0, " India", " >50K"),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if c in ('age', 'capital-gain', 'capital-loss') else 'string'}" for c in COLUMNS))
    path = str(tmp_path / "adult.parquet")
    raw.write.parquet(path)
    rg.register_dataset(rg.DatasetSpec(name="adult", path=path, label="salary", prepare=rg.ENCODINGS["adult"]))
    got = rg.load_dataset(spark, "adult")
    assert got.columns == ["age", "marital-status", "relationship", "race", "sex", "capital-gain", "capital-loss", "country",
                           "salary", "employment_type"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        (28, None, 1, 4, 0, 0, 0, 0, 0, 3), (39, 1, 4, 3, 1, 1, 0, 1, 1, 0), (50, 0, 2, 0, 0, 0, 1, 0, 0, 2)]


def test_unknown_strict_value_raises(spark):
    raw = spark.createDataFrame([(" Male", " maybe")], "sex string, salary string")
    with pytest.raises(Exception, match="unmapped value"):
        rg.Encoding(codes={"salary": rg.ADULT.codes["salary"]})(raw).collect()


def test_seer_encoding(spark):
    flags = [*rg.SEER.onehots["grade"], *rg.SEER.onehots["stage"]]
    raw = spark.createDataFrame([(0, 1, 0, 0, 0, 0, 0, 0, 0, 1)], ", ".join(f"`{c}` int" for c in flags))
    row = rg.SEER(raw).first()
    assert (row["grade"], row["stage"]) == (2, 5)


def csv(folder, name, header, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")
    return str(folder)


def test_known_sets_are_registered():
    assert {"adult", "compas", "covid", "cutract", "drug", "higgs", "maggic", "seer", "support"} <= set(rg.known_datasets())


def test_drug_from_csv(spark, tmp_path):
    levels = list(rg.DRUG.orderings)[2:]
    header = ",".join(["ID", "Age", "Gender", "Education", "Country", "Ethnicity", *levels, "Semer", "Caff", "Choc"])

    def line(i, age, gender, country, nicotine, semer):
        use = ["CL" + str(k % 7) if n != "Nicotine" else nicotine for k, n in enumerate(levels)]
        return ",".join([str(i), age, gender, "Masters degree", country, "White", *use, semer, "CL5", "CL6"])

    folder = csv(tmp_path / "data", "Drug_Consumption.csv", header, [
        line(1, "18-24", "M", "UK", "CL0", "CL0"), line(2, "65+", "F", "Canada", "CL1", "CL0"), line(3, "25-34", "", "", "CL2", "CL0"),
        line(4, "18-24", "M", "Other", "CL6", "CL4")])  # an overclaimer: its country takes no code
    got = rg.load_dataset(spark, "drug", folders=[str(tmp_path / "none"), folder])
    assert not {"ID", "Nicotine", "Semer", "Caff", "Choc"} & set(got.columns)
    assert sorted((r["Age"], r["Gender"], r["Education"], r["Country"], r["Ethnicity"], r["Amyl"], r["VSA"], r["y"]) for r in got.collect()) == [
        (0, 1, 7, 1, 0, 1, 1, 0), (1, 0, 7, -1, 0, 1, 1, 1), (5, 0, 7, 0, 0, 1, 1, 0)]


def test_higgs_support_and_maggic(spark, tmp_path):
    folder = csv(tmp_path / "data", "training.csv", ",".join(["PRI_met", *rg.HIGGS.drop, "Label"]), ["1.5," + "0," * 9 + "s", "2.5," + "0," * 9 + "b"])
    csv(tmp_path / "data", "support_data.csv", ",age,d.time,death", ["0,60.5,12,1", "1,70.5,3,0"])
    csv(tmp_path / "data", "Maggic.csv", "age,days_to_fu,death_all", ["61,9,0"])
    assert sorted(map(tuple, rg.load_dataset(spark, "higgs", folders=[folder]).select("PRI_met", "y").collect())) == [(1.5, 0), (2.5, 1)]
    support = rg.load_dataset(spark, "support", folders=[folder])
    assert support.columns == ["age", "death"] and sorted(map(tuple, support.collect())) == [(60.5, 1), (70.5, 0)]
    assert rg.load_dataset(spark, "maggic", folders=[folder]).columns == ["age", "death_all"]


def test_covid_by_position(spark, tmp_path):
    names = [f"c{i}" for i in range(34)]
    names[0], names[7], names[9] = "died", "Race", "SG_UF_NOT"
    folder = csv(tmp_path / "data", "covid.csv", ",".join(names), [",".join(str(100 + i) for i in range(34))])
    got = rg.load_dataset(spark, "covid", folders=[folder])
    assert got.columns == ["c2", "c3", "c5", "c6", "c8", *[f"c{i}" for i in range(10, 34)], "died"]
    assert got.first()["died"] == 100 and got.first()["c33"] == 133


def test_balanced_classes(spark, tmp_path):
    """Both classes hold as many rows whatever their share; repeated rows count one by one; a small class raises."""
    flags = [*rg.SEER.onehots["grade"], *rg.SEER.onehots["stage"]]
    names = [*dict.fromkeys([c for c in rg.CANCER_FEATURES if c != "grade"] + flags), "mort", "mortCancer"]
    rows = [",".join(["True" if n == "mortCancer" and i % 9 == 0 else "False" if n in ("mort", "mortCancer") else str(i % 3) for n in names])
            for i in range(900)]
    folder = csv(tmp_path / "data", "cutract.csv", ",".join(names), rows)
    load = lambda **kw: rg.load_dataset(spark, "cutract", folders=[folder], **kw)
    got = load(prop=0.1)
    assert got.columns == [*rg.CANCER_FEATURES, "mortCancer"]
    assert {r["mortCancer"]: r["count"] for r in got.groupBy("mortCancer").count().collect()} == {0: 100, 1: 100}
    assert sorted(got.collect(), key=str) == sorted(load(prop=0.1).collect(), key=str)
    with pytest.raises(ValueError, match="fewer than 101 rows"):
        load(prop=0.101)


def test_a_parquet_copy_goes_first(spark, tmp_path):
    folder = csv(tmp_path / "data", "Maggic.csv", "age,days_to_fu,death_all", ["61,9,0"])
    spark.createDataFrame([(5, 1, 1)], "age int, days_to_fu int, death_all int").write.parquet(folder + "/Maggic.parquet")
    assert rg.load_dataset(spark, "maggic", folders=[folder]).first()["age"] == 5
