"""Cleaning of generated rows (C1-C8) on parsed fragments.

Input is the output of ``completions.parse_completions``: one row per JSON
object with the VARIANT ``_v`` (per-cell JSON types preserved). Every step is
a per-row column expression, so all of it is narrow (no shuffle) and runs
unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructType)

from rowsift.functions.encode import map_values, repair_label, restore_names
from rowsift.operators.completions import bound, cell, cell_kind

# Placeholder words (type names an LLM echoes instead of values).
PLACEHOLDERS_PARSE = ["integer", "float", "numeric", "categorical"]
PLACEHOLDERS_CLEAN = ["integer", "float", "numeric", "categorical", "number", "No", "Yes",
                      "continuous", "age in years", "string"]

_INT_TYPES = (IntegerType, LongType)
_FLOAT_TYPES = (DoubleType, FloatType)


def _all_cells_map(v: Column) -> Column:
    """All keys -> text (strings unquoted); used where *every* cell matters."""
    return F.from_json(F.to_json(v), "map<string,string>")


# ------------------------------------------------------------------ C1
def has_placeholder(v: Column, words: Sequence[str] = PLACEHOLDERS_CLEAN) -> Column:
    """Any *string* cell (any key, extras included) equal to a word; case-sensitive, whole cell."""
    m = _all_cells_map(v)
    kinds = F.upper(F.schema_of_variant(v))
    lit_words = F.array(*[F.lit(w) for w in words])
    # map text of a JSON number never equals a word, so a text match implies a string cell
    return F.coalesce(F.exists(F.map_values(m), lambda x: F.array_contains(lit_words, x)), F.lit(False)) & kinds.isNotNull()


def drop_placeholders(df: DataFrame, words: Sequence[str] = PLACEHOLDERS_CLEAN, v: str = "_v") -> DataFrame:
    if "frag" in df.columns:  # the raw fragment text is at hand: one map parse, no re-serialisation
        m = F.from_json(F.col("frag"), "map<string,string>")
        lit_words = F.array(*[F.lit(w) for w in words])
        return df.where(~F.coalesce(F.exists(F.map_values(m), lambda x: F.array_contains(lit_words, x)), F.lit(False)))
    return df.where(~has_placeholder(F.col(v), words))


# ------------------------------------------------------------------ C2
def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Any NULL (and NaN for floating columns, as pandas treats it) removes the row."""
    cols = list(subset) if subset is not None else [c for c in df.columns]
    cond = None
    for c in cols:
        t = df.schema[c].dataType
        bad = F.col(c).isNull()
        if isinstance(t, _FLOAT_TYPES):
            bad = bad | F.isnan(F.col(c))
        cond = bad if cond is None else (cond | bad)
    return df if cond is None else df.where(~cond)


# ------------------------------------------------------------------ C3 / C4
def sentinel_to_null(c: Column, sentinel=" ?") -> Column:
    return F.nullif(c, F.lit(sentinel))


def keep_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


# ------------------------------------------------------------------ C7
def has_list_cell(v: Column) -> Column:
    """Any cell (any key) holding a JSON array."""
    return F.coalesce(F.upper(F.schema_of_variant(v)).contains(": ARRAY<"), F.lit(False))


def drop_list_rows(df: DataFrame, v: str = "_v") -> DataFrame:
    return df.where(~has_list_cell(F.col(v)))


# ------------------------------------------------------------------ C5 / C6
def _filled(v: Column, name: str, fallback: str | None) -> Column:
    """The cell; with a fallback (P17) a null / missing cell takes the fallback key's cell."""
    if fallback is None:
        return cell(v, name)
    return bound(cell(v, name), lambda c: F.when(c["kind"].isin("null", "missing"), cell(v, fallback)).otherwise(c))


def _pair(val: Column, ok: Column) -> Column:
    return F.struct(val.alias("value"), ok.alias("ok"))


def convert_cell(v: Column, name: str, dtype, int_strings: str = "strict", fallback: str | None = None) -> Column:
    """``value`` (converted) and ``ok`` for one target column, as a struct.

    int  : JSON number truncates; string must be an integer literal
           (``coerce``: any number text, then truncated); true/false -> 1/0;
           null, missing, lists, objects reject.
    float: number; numeric string; bool -> 1.0/0.0; null / missing kept as NULL.
    string: text of strings / numbers / bools; null / missing kept as NULL.
    """
    def judged(c):
        empty = c["kind"].isin("null", "missing")
        return bound(_converted(c, dtype, int_strings), lambda x: _pair(x.cast(dtype), x.isNotNull() if isinstance(dtype, _INT_TYPES) else x.isNotNull() | empty))
    return bound(_filled(v, name, fallback), judged)


def _converted(c: Column, dtype, int_strings: str) -> Column:
    kind, text, num = c["kind"], c["text"], c["num"]
    if isinstance(dtype, _INT_TYPES):
        if int_strings == "strict":
            from_str = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))
        else:
            from_str = F.trim(text).try_cast("double").cast("bigint")
        val = (F.when(kind == "number", num.cast("bigint"))
                .when(kind == "string", from_str)
                .when(kind == "bool", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
        return val
    if isinstance(dtype, _FLOAT_TYPES):
        s = F.trim(text).try_cast("double")
        val = (F.when(kind == "number", num)
                .when(kind == "string", s)
                .when(kind == "bool", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0))))
        return bound(val, lambda x: F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x))  # NaN -> NULL once
    if isinstance(dtype, BooleanType):
        return F.when(kind == "bool", text == "true")
    if isinstance(dtype, StringType):
        return F.when(kind.isin("string", "number", "bool"), text)
    raise TypeError(f"unsupported target type {dtype}")


#: How a cell is repaired: a dictionary from its text, or "label" for the income label.
Repair = Mapping[str, int] | Literal["label"]


def repaired_cell(v: Column, name: str, dtype, repair: Repair) -> Column:
    """``value`` (repaired) and ``ok`` as a struct: a text outside the dictionary, or a label without a number, rejects the row."""
    def repaired(c):
        kind, text = c["kind"], c["text"]
        if repair != "label":
            return map_values(F.when(kind == "string", text), repair)
        number = (F.when(kind == "number", c["num"]).when(kind == "string", F.trim(text).try_cast("double"))
                   .when(kind == "bool", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0))))
        return bound(number, repair_label)
    return bound(bound(cell(v, name), repaired), lambda x: _pair(x.cast(dtype), x.isNotNull()))


def conform(df: DataFrame, schema: StructType, int_strings: str = "strict", v: str = "_v",
            keep: Sequence[str] = (), fallbacks: dict | None = None, repairs: Mapping[str, Repair] | None = None,
            any_list: bool = True) -> tuple[DataFrame, DataFrame]:
    """(conformed rows typed as ``schema``, rejected rows with the first failing column).

    Rows with a list cell are removed first (C7; without ``any_list`` only target cells count, and a list
    there is rejected); each remaining row is kept iff every target cell converts.
    """
    if any_list:
        df = drop_list_rows(df, v)
    cells = []
    for f in schema.fields:
        if f.name in (repairs or {}):
            found = repaired_cell(F.col(v), f.name, f.dataType, repairs[f.name])
        else:
            found = convert_cell(F.col(v), f.name, f.dataType, int_strings, (fallbacks or {}).get(f.name))
        cells.append(found.alias(f.name))
    # behind the generator the cells are values: a filter on them doesn't carry their expressions before it
    staged = df.select(*keep, F.explode(F.array(F.struct(*cells))).alias("_cells"))
    bad = F.coalesce(*[F.when(~F.col("_cells")[f.name]["ok"], F.lit(f.name)) for f in schema.fields])
    good = staged.where(bad.isNull()).select(*keep, *[F.col("_cells")[f.name]["value"].alias(f.name) for f in schema.fields])
    rejects = staged.where(bad.isNotNull()).select(*keep, bad.alias("reject_column"))
    return good, rejects


# ------------------------------------------------------------------ C8
PRESETS = {
    # order of steps per generator family (see README)
    "gpt": ["placeholders", "select_like", "dropna", "conform", "restore_names"],
    "llama": ["placeholders", "repairs", "conform", "restore_names"],
    "together": ["fill_target", "select_like", "placeholders", "conform", "restore_names"],
    "swahili": ["dropna_raw", "placeholders", "select_like", "conform", "restore_names"],
}


def _drop_null_cells(df: DataFrame, names: Sequence[str], v: str) -> DataFrame:
    cond = None
    for n in names:
        bad = cell_kind(F.col(v), n).isin("null", "missing")
        cond = bad if cond is None else cond | bad
    return df if cond is None else df.where(~cond)


def _target_placeholders(v: Column, names: Sequence[str], words: Sequence[str], fallbacks: Mapping[str, str]) -> Column:
    """C1 over the target cells alone, each after its fallback."""
    found = F.lit(False)
    for n in names:
        found = found | bound(_filled(v, n, fallbacks.get(n)), lambda c: F.coalesce((c["kind"] == "string") & c["text"].isin(list(words)), F.lit(False)))
    return found


def clean_generated(parsed: DataFrame, schema: StructType, preset: str = "gpt",
                    keep: Sequence[str] = ("source", "iter", "choice", "frag_pos"),
                    v: str = "_v", fill: Mapping[str, str] | None = None, repairs: Mapping[str, Repair] | None = None,
                    original: Sequence[str] | None = None) -> DataFrame:
    """One cleaning entry point; ``preset`` names the step order of a generator family.

    * placeholders: C1 with the 10-word vocabulary;
    * select_like (P16): from here on only target cells count, for placeholders and lists, too;
    * dropna / dropna_raw (C2): NULL or missing target cells remove the row;
    * fill_target (P17): a NULL or missing cell takes another one (``fill``: by default ``target`` takes ``y``);
    * repairs (C7/P18): list rows removed, the columns in ``repairs`` by a dictionary or by the label rule;
    * conform (C5/C6): ``gpt`` coerces int strings, the others are strict;
    * restore_names (P15): the target columns get their ``original`` names back, if given.
    """
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; use one of {sorted(PRESETS)}")
    if repairs and "repairs" not in PRESETS[preset]:
        raise ValueError(f"preset {preset!r} repairs no column")
    if original is not None and len(original) != len(schema.fields):
        raise ValueError(f"{len(original)} original names for {len(schema.fields)} columns")
    keep = [k for k in keep if k in parsed.columns]
    names = [f.name for f in schema.fields]
    df = parsed
    fallbacks, selected = {}, False
    for step in PRESETS[preset]:
        if step == "placeholders":
            df = df.where(~_target_placeholders(F.col(v), names, PLACEHOLDERS_CLEAN, fallbacks)) if selected else drop_placeholders(df, PLACEHOLDERS_CLEAN, v)
        elif step == "select_like":
            selected = True
        elif step in ("dropna", "dropna_raw"):
            df = _drop_null_cells(df, names, v)
        elif step == "fill_target":
            fallbacks = dict(fill) if fill is not None else {"target": "y"} if "target" in names else {}
        elif step == "repairs":
            df = drop_list_rows(df, v)
    good, _ = conform(df, schema, int_strings="coerce" if preset == "gpt" else "strict", v=v, keep=keep,
                      fallbacks=fallbacks, repairs=repairs, any_list=not selected)
    return good if original is None else restore_names(good, [*keep, *original])
