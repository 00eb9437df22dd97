"""Sources and sinks (S1-S6): scans, a dataset registry, result bundles.

A *bundle* is one long DataFrame with a ``source`` column instead of a dict
of aligned frames; on disk it is parquet partitioned by
``dataset/ns/seed/source`` so a grid of results is read back with partition
pruning and missing cells are simply absent.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowsift.functions import encode as enc

PARTITION_KEYS = ("dataset", "ns", "seed", "source")


# ------------------------------------------------------------------ S1
def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             delimiter: str = ",") -> DataFrame:
    """Header CSV; declared schema preferred (inference costs a full extra pass)."""
    r = spark.read.option("header", True).option("delimiter", delimiter)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_csv(spark, path, **kw)
    return spark.read.format(fmt).load(path)


# ------------------------------------------------------------------ S2
def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster's Hadoop file system (works for shared storage)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_first(spark: SparkSession, paths: Sequence[str], **kw) -> DataFrame:
    """Read the first existing path of a list (for data sets: ``data/``, then ``../data/``)."""
    for p in paths:
        if path_exists(spark, p):
            return read_table(spark, p, **kw)
    raise FileNotFoundError(f"none of {list(paths)} exists")


# ------------------------------------------------------------------ S3
@dataclass
class DatasetSpec:
    """Where a data set lies and how it becomes features and a label. A relative ``path`` is looked up in the
    folders given to ``load_dataset``. ``label`` is a name or a position; ``positions`` pick the features by
    place in the raw table, before ``prepare``. ``per_class``: so many rows of each class make the whole data set."""
    name: str
    path: str
    label: str | int
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    drop: Sequence[str] = ()
    features: Sequence[str] | None = None
    fmt: str | None = None
    schema: StructType | str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    positions: Sequence[int] | None = None
    per_class: int | None = None


@dataclass(frozen=True)
class Codes:
    """Codes of a column's values. A value outside the list gets ``other`` (NULL by default), or raises if ``strict``."""
    values: Mapping[str, int]
    source: str | None = None
    other: int | None = None
    strict: bool = False

    def column(self, name: str) -> Column:
        code = enc.map_values(enc.q(self.source or name), self.values, strict=self.strict)
        return code if self.other is None else F.coalesce(code, F.lit(self.other))


@dataclass(frozen=True)
class Encoding:
    """How a raw table becomes a coded one. Only rows that hold the values in ``only`` stay. Rows with a
    missing cell (NULL or the column's mark in ``missing``) go if any mark is named; ``indicators`` become 1
    above zero; ``onehots`` name the flag columns that one ordinal column replaces; ``integers`` are cast;
    ``orderings`` give a value its place in a list (others raise), ``nominal`` its place among the sorted
    distinct values (NULL: -1); ``outside`` makes a column that is 1 where a coded one is none of some values."""
    only: Mapping[str, str] = field(default_factory=dict)
    codes: Mapping[str, Codes] = field(default_factory=dict)
    missing: Mapping[str, str] = field(default_factory=dict)
    indicators: Sequence[str] = ()
    onehots: Mapping[str, Sequence[str]] = field(default_factory=dict)
    integers: Sequence[str] = ()
    orderings: Mapping[str, Sequence[str]] = field(default_factory=dict)
    nominal: Sequence[str] = ()
    outside: Mapping[str, tuple[str, Sequence[int]]] = field(default_factory=dict)
    drop: Sequence[str] = ()
    renames: Mapping[str, str] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        for n, value in self.only.items():
            df = df.where(enc.q(n) == value)
        strict = {n: c.column(n) for n, c in self.codes.items() if c.strict}
        marks = {n: F.nullif(enc.q(n), F.lit(mark)) for n, mark in self.missing.items()}
        if strict or marks:
            df = df.withColumns(strict | marks)
        if marks:
            df = df.na.drop(how="any")
        made = {n: c.column(n) for n, c in self.codes.items() if not c.strict}
        made |= {n: enc.sign_indicator(enc.q(n)) for n in self.indicators}
        made |= {n: enc.onehot_to_ordinal(list(flags)) for n, flags in self.onehots.items()}
        made |= {n: enc.q(n).cast("int") for n in self.integers}
        made |= {n: enc.ordinal_encode(enc.q(n), order).cast("int") for n, order in self.orderings.items()}
        df = df.withColumns(made) if made else df
        for n in self.nominal:
            df = enc.nominal_codes(df, n)
        if self.outside:
            df = df.withColumns({n: enc.binary_not_in(enc.q(c), values) for n, (c, values) in self.outside.items()})
        return enc.rename(df.drop(*self.drop), self.renames)


# Category vocabularies and their codes (leading spaces are part of the data).
ADULT = Encoding(
    codes={
        "salary": Codes({" <=50K": 1, " >50K": 0}, strict=True),
        "sex": Codes({" Male": 1, " Female": 0}, strict=True),
        "country": Codes({" United-States": 1}, other=0),
        "marital-status": Codes({" Divorced": 1, " Married-spouse-absent": 1, " Never-married": 1, " Separated": 1,
                                 " Widowed": 1, " Married-AF-spouse": 0, " Married-civ-spouse": 0}),
        "relationship": Codes({" Unmarried": 0, " Wife": 1, " Husband": 2, " Not-in-family": 3, " Own-child": 4,
                               " Other-relative": 5}),
        "race": Codes({" White": 0, " Amer-Indian-Eskimo": 1, " Asian-Pac-Islander": 2, " Black": 3, " Other": 4}),
        "employment_type": Codes({" Federal-gov": 0, " Local-gov": 0, " State-gov": 0, " Private": 1,
                                  " Self-emp-inc": 2, " Self-emp-not-inc": 2}, source="workclass", other=3),
    },
    missing={"country": " ?", "workclass": " ?", "occupation": " ?"},
    indicators=("capital-gain", "capital-loss"),
    drop=("workclass", "education", "occupation"))
SEER = Encoding(onehots={"grade": [f"grade_{i}.0" for i in range(1, 6)], "stage": [f"stage_{i}" for i in range(1, 6)]})
CANCER = replace(SEER, integers=("mort", "mortCancer"))
USE = [f"CL{i}" for i in range(7)]
DRUG = Encoding(
    only={"Semer": "CL0"},
    codes={"Gender": Codes({"M": 1}, other=0)},
    orderings={
        "Age": ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"],
        "Education": ["Left school before 16 years", "Left school at 16 years", "Left school at 17 years",
                      "Left school at 18 years", "Some college or university, no certificate or degree",
                      "Professional certificate/ diploma", "University degree", "Masters degree", "Doctorate degree"],
        **dict.fromkeys(["Alcohol", "Amyl", "Amphet", "Benzos", "Cannabis", "Coke", "Crack", "Ecstasy", "Heroin", "Ketamine",
                         "Legalh", "LSD", "Meth", "Mushrooms", "Nicotine", "VSA"], USE)},
    nominal=("Country", "Ethnicity"),
    outside={"y": ("Nicotine", (0, 1))},
    drop=("Semer", "Caff", "Choc", "ID", "Nicotine"))
HIGGS = Encoding(
    codes={"Label": Codes({"s": 0, "b": 1}, strict=True)},
    drop=("EventId", "DER_deltaeta_jet_jet", "DER_mass_jet_jet", "DER_prodeta_jet_jet", "DER_lep_eta_centrality",
          "PRI_jet_subleading_pt", "PRI_jet_subleading_eta", "PRI_jet_subleading_phi", "Weight"),
    renames={"Label": "y"})
SUPPORT = Encoding(drop=("Unnamed: 0", "_c0", "d.time"))  # a nameless first column has either name
MAGGIC = Encoding(drop=("days_to_fu",))

#: Encodings by data set name, for ``DatasetSpec.prepare``.
ENCODINGS = {"adult": ADULT, "seer": CANCER, "cutract": CANCER, "drug": DRUG, "higgs": HIGGS, "support": SUPPORT, "maggic": MAGGIC}
CANCER_FEATURES = ("age", "psa", "comorbidities", "treatment_CM", "treatment_Primary hormone therapy", "treatment_Radical Therapy-RDx",
                   "treatment_Radical therapy-Sx", "grade", "stage_1", "stage_2", "stage_3", "stage_4")


_REGISTRY: dict[str, DatasetSpec] = {}


def register_dataset(spec: DatasetSpec) -> None:
    _REGISTRY[spec.name] = spec


def known_datasets() -> list[str]:
    return sorted(_REGISTRY)


# File names, labels, feature places and class sizes of the known data sets.
for _spec in (
        DatasetSpec("adult", "adult.csv", "salary", ADULT),
        DatasetSpec("seer", "seer.csv", "mortCancer", CANCER, features=CANCER_FEATURES, per_class=10_000),
        DatasetSpec("cutract", "cutract.csv", "mortCancer", CANCER, features=CANCER_FEATURES, per_class=1_000),
        DatasetSpec("covid", "covid.csv", 0, positions=(2, 3, *range(5, 34)), drop=("Race", "SG_UF_NOT")),
        DatasetSpec("support", "support_data.csv", "death", SUPPORT),
        DatasetSpec("maggic", "Maggic.csv", "death_all", MAGGIC),
        DatasetSpec("drug", "Drug_Consumption.csv", "y", DRUG),
        DatasetSpec("higgs", "training.csv", "y", HIGGS),
        DatasetSpec("compas", "compas.csv", "y")):
    register_dataset(_spec)


def _candidates(path: str, folders: Sequence[str]) -> list[str]:
    """A Parquet copy of a CSV file goes before it, and an earlier folder before a later one."""
    if path.startswith("/") or ":" in path:
        return [path]
    names = [path[:-4] + ".parquet", path] if path.endswith(".csv") else [path]
    return [f"{d.rstrip('/')}/{n}" for d in folders for n in names]


def _balanced(df: DataFrame, label: str, n: int, key: str | None, seed: int) -> DataFrame:
    """``n`` rows of each class by hash order of the key, or of the whole row if there is none (rows that tie are equal then)."""
    from rowsift.operators.sampling import class_counts, stratified_sample
    small = [r[label] for r in class_counts(df, label).where(F.col("n") < n).limit(10).collect()]
    if small:
        raise ValueError(f"fewer than {n} rows in classes {small}")
    if key is not None:
        return stratified_sample(df, label, n, key, seed)
    made = df.withColumn("_row", F.to_json(F.struct(*[enc.q(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return stratified_sample(made, label, n, "_row", seed).drop("_row")


def load_dataset(spark: SparkSession, name: str, seed: int = 42, prop: float = 1.0,
                 key: str | None = None, folders: Sequence[str] = ("data", "../data")) -> DataFrame:
    """Registry lookup -> scan -> prepare -> drop -> sample: ``per_class * prop`` rows a class where the data set
    is balanced, else a replayable fraction of the rows (which needs a key)."""
    if name not in _REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; registered: {known_datasets()}")
    spec = _REGISTRY[name]
    df = read_first(spark, _candidates(spec.path, folders), fmt=spec.fmt, **({"schema": spec.schema} if spec.schema else {}))
    label = df.columns[spec.label] if isinstance(spec.label, int) else spec.label
    if spec.positions is not None:
        df = enc.select_positions(df, [*spec.positions, df.columns.index(label)])
    df = spec.prepare(df)
    if spec.drop:
        df = df.drop(*spec.drop)
    if spec.per_class is not None:
        df = _balanced(df, label, int(prop * spec.per_class), key, seed)
    if spec.features is not None:
        df = df.select(*[enc.q(c) for c in spec.features], enc.q(label))
    if prop < 1.0 and spec.per_class is None:
        from rowsift.operators.sampling import fraction_sample
        if key is None:
            raise ValueError("a key column is needed for a replayable fraction sample")
        df = fraction_sample(df, key, prop, seed)
    return df


def register_table_dataset(name: str, sf_dir: str, table: str, label: str,
                           prepare: Callable[[DataFrame], DataFrame] = lambda d: d,
                           drop: Sequence[str] = ()) -> None:
    register_dataset(DatasetSpec(name=name, path=f"{sf_dir.rstrip('/')}/{table}.parquet", label=label,
                                 prepare=prepare, drop=drop, fmt="parquet"))


# ------------------------------------------------------------------ S4 / S5
def save_bundle(df: DataFrame, path: str, partition_by: Sequence[str] = PARTITION_KEYS,
                mode: str = "overwrite") -> None:
    """Write a long result table; dynamic partition overwrite replaces only the cells written."""
    keys = [k for k in partition_by if k in df.columns]
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if keys:
        w = w.partitionBy(*keys)
    w.parquet(path)


def load_bundles(spark: SparkSession, path: str, **filters) -> DataFrame:
    """Read a grid of bundles; equality / list filters on partition keys are pruned at scan."""
    df = spark.read.option("basePath", path).parquet(path)
    for k, v in filters.items():
        df = df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


# ------------------------------------------------------------------ S6
def tag_and_union(frames: Mapping[str, DataFrame], label: str | None = None,
                  target: str = "target") -> DataFrame:
    """Dict of frames -> one long frame with ``source``; columns unioned by name."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("source", F.lit(name))
        if label is not None and label in d.columns and label != target:
            d = d.withColumnRenamed(label, target)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
