"""Prompt rows and completions as table jobs (G1-G10, with D7/D8 for the draws).

Parsing is pure JVM: ``regexp_extract_all`` finds the innermost brace
groups, ``try_parse_json`` (VARIANT) validates each fragment with strict JSON
(single quotes rejected) and keeps per-cell JSON types, and a higher-order
``forall`` decides per completion whether every fragment parsed - a per-row
expression, so the same code runs on a stream (ST1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAGMENT_PATTERN = r"(\{[^{}]*\})"
COMPLETION_KEYS = ("source", "iter", "choice")


# ------------------------------------------------------------------ G1
def serialise_records(df: DataFrame, group: Sequence[str], cols: Sequence[str],
                      order: str | None = None, name: str = "data") -> DataFrame:
    """Per group: a JSON record list of ``cols`` (ordered by ``order``); groups are bounded prompt batches."""
    order = order or cols[0]
    rec = F.struct(F.col(order).alias("_o"), F.struct(*[F.col(c) for c in cols]).alias("r"))
    return df.groupBy(*group).agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(rec)), lambda x: x["r"])).alias(name))


# ------------------------------------------------------------------ G2
def descriptors(columns: Sequence[str], label: str, label_description: str = "binary label",
                rename_label_to: str | None = "target") -> list[tuple[str, str, str]]:
    """(name, output_name, description) per column; labels get the label description."""
    out = []
    for c in columns:
        if c == label:
            out.append((c, rename_label_to or c, label_description))
        else:
            out.append((c, c, "feature column"))
    return out


def format_instructions(descs: Sequence[tuple[str, str, str]]) -> str:
    fields = ", ".join(f'"{o}": {d}' for _, o, d in descs)
    return "Return each generated row as a JSON object with the keys {" + fields + "}."


# ------------------------------------------------------------------ G3
DEFAULT_SYSTEM = "Answer with table rows only."
DEFAULT_TEMPLATE = ("Here are examples from a real table:\n{data}\n"
                    "Generate more rows that follow the same distribution.\n{format_instructions}")


def build_prompts(batches: DataFrame, templates: DataFrame | None = None,
                  template: str = DEFAULT_TEMPLATE, instructions: str = "",
                  dataset_col: str | None = None, strip_first_line: bool = False) -> DataFrame:
    """Fill ``{data}`` / ``{format_instructions}``; per-dataset templates come from a small
    ``(dataset, template)`` table joined on the dataset (broadcast: one row per dataset)."""
    if templates is not None and dataset_col:
        t = F.col("template")
        df = batches.join(F.broadcast(templates), dataset_col, "left")
        t = F.coalesce(t, F.lit(template))
    else:
        df, t = batches, F.lit(template)
    user = F.replace(F.replace(t, F.lit("{data}"), F.col("data")), F.lit("{format_instructions}"),
                     F.lit(instructions))
    if strip_first_line:
        user = F.regexp_replace(F.regexp_replace(user, r"^[^\n]*\n", ""), "\n", " ")
    out = df.withColumn("system", F.lit(DEFAULT_SYSTEM)).withColumn("user", user)
    return out.drop("template") if "template" in out.columns else out


# ------------------------------------------------------------------ G4
def generate(prompts: DataFrame, generator_fn: Callable[[pd.DataFrame], pd.DataFrame],
             n: int = 1, schema: str = "source string, iter int, choice int, text string") -> DataFrame:
    """Obtain ``n`` completions per prompt through a user callable (Arrow batches).

    ``generator_fn(pdf)`` receives prompt rows plus a ``choice`` column and
    returns rows of ``schema``. The network client is the caller's concern.
    """
    expanded = prompts.withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches):
        for pdf in batches:
            yield generator_fn(pdf)

    return expanded.mapInPandas(run, schema)


# ------------------------------------------------------------------ G5
def fragments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FRAGMENT_PATTERN), 1)


def explode_fragments(df: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(fragments(F.col(text))).alias("frag_pos", "frag"))


# ------------------------------------------------------------------ G6
def _is_object(v: Column) -> Column:
    return F.coalesce(F.upper(F.schema_of_variant(v)).startswith("OBJECT"), F.lit(False))


def fragment_valid(frag: Column) -> Column:
    """Strict JSON (no single quotes). Fragments come from the ``{...}`` pattern, so a
    fragment that parses is an object."""
    return F.try_parse_json(frag).isNotNull()


def completion_valid(text: Column) -> Column:
    """Every fragment of the completion parses (an invalid one discards the whole completion)."""
    return F.forall(fragments(text), lambda f: fragment_valid(f))


def parse_completions(df: DataFrame, text: str = "text", policy: str = "completion") -> DataFrame:
    """Completions -> one row per parsed fragment ``(keys..., frag_pos, frag, _v VARIANT)``.

    Each fragment is parsed once (array of (frag, variant)); ``policy='completion'``
    (reference behaviour) keeps a completion only if all its fragments parsed,
    ``'per_fragment'`` keeps the good fragments of every completion.
    """
    if policy not in ("completion", "per_fragment"):
        raise ValueError("policy must be 'completion' or 'per_fragment'")
    keep = [c for c in df.columns if c != text]
    parsed = F.transform(fragments(F.col(text)), lambda f: F.struct(f.alias("frag"), F.try_parse_json(f).alias("v")))
    if policy == "completion":
        parsed = bound(parsed, lambda p: F.when(F.forall(p, lambda s: s["v"].isNotNull()), p))
    # outer: for a plain explode Spark would compute the array again in filters on its size; the rows of empty arrays go below
    ex = df.select(*keep, F.posexplode_outer(parsed).alias("frag_pos", "_s"))
    ex = ex.select(*keep, "frag_pos", F.col("_s.frag").alias("frag"), F.col("_s.v").alias("_v"))
    return ex.where(F.col("_v").isNotNull())


# ------------------------------------------------------------------ cell access (shared with clean.py)
def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once: Spark would repeat its expression at every place of ``f`` that names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _kind_of(k: Column) -> Column:
    return (F.when(k.isNull(), "missing").when(k == "VOID", "null").when(k == "STRING", "string")
             .when(k == "BOOLEAN", "bool").when(k.startswith("ARRAY"), "array")
             .when(k.startswith("OBJECT"), "object").otherwise("number"))


def _text_of(c: Column, k: Column) -> Column:
    is_float = k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
    return F.when(is_float, F.try_variant_get(c, "$", "double").cast("string")).otherwise(F.variant_get(c, "$", "string"))


def _with_type(v: Column, name: str, f: Callable[[Column, Column], Column]) -> Column:
    """``f(cell, upper-case type of the cell)``, both computed once."""
    return bound(F.variant_get(v, _path(name), "variant"), lambda c: bound(F.upper(F.schema_of_variant(c)), lambda k: f(c, k)))


def cell_kind(v: Column, name: str) -> Column:
    """string / number / bool / array / object / null / missing."""
    return _with_type(v, name, lambda _, k: _kind_of(k))


def cell_text(v: Column, name: str) -> Column:
    """Text of a cell as Python would print the parsed value: integers as written,
    any number with a fraction / exponent as a float (``261347.00`` -> ``261347.0``)."""
    return _with_type(v, name, _text_of)


def cell_double(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _path(name), "double")


def cell(v: Column, name: str) -> Column:
    """``kind``, ``text`` and ``num`` of a cell as a struct, from one look into the variant."""
    return _with_type(v, name, lambda c, k: F.struct(_kind_of(k).alias("kind"), _text_of(c, k).alias("text"),
                                                     F.try_variant_get(c, "$", "double").alias("num")))


# ------------------------------------------------------------------ G7
def to_columns(parsed: DataFrame, columns: Sequence[str], keep: Sequence[str] = COMPLETION_KEYS + ("frag_pos",),
               v: str = "_v") -> DataFrame:
    """Variant rows -> declared superset of string columns (missing keys -> NULL)."""
    return parsed.select(*keep, *[cell_text(F.col(v), c).alias(c) for c in columns])


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------ G8
def quota_cut(rows: DataFrame, target: int, by: Sequence[str] = ("source",), it: str = "iter",
              max_rounds: int | None = None) -> DataFrame:
    """Keep every round up to and including the first whose cumulative row count >= target.

    Per-round counts are a small aggregate (rounds per source, <= max_rounds);
    the running sum runs on it, and the kept rounds join back on (source, iter).
    ``max_rounds`` mirrors the reference's round limit (500) when given.
    """
    src = rows if max_rounds is None else rows.where(F.col(it) < max_rounds)  # reference stops at 500
    counts = src.groupBy(*by, it).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(it).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_n").over(w))
    counts = counts.withColumn("_prev", F.col("_cum") - F.col("_n"))
    keep = counts.where(F.col("_prev") < target).select(*by, it)
    return rows.join(keep, list(by) + [it], "left_semi")


# ------------------------------------------------------------------ G9
def reaccumulate(rows: DataFrame, by: Sequence[str] = ("source",), it: str = "iter") -> DataFrame:
    """Round k re-adds rounds 1..k: a row of round r appears once per round r..last (``round`` column)."""
    last = rows.groupBy(*by).agg(F.max(it).alias("_last"))
    j = rows.join(last, list(by), "left")
    return j.withColumn("round", F.explode(F.sequence(F.col(it), F.col("_last")))).drop("_last")


def reaccumulated_counts(rows: DataFrame, by: Sequence[str] = ("source",), it: str = "iter") -> DataFrame:
    """Row count per round under re-accumulation without materialising the copies:
    a running sum over the (small) per-round counts."""
    counts = rows.groupBy(*by, it).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(it).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, F.col(it).cast("int").alias("round"), F.sum("_n").over(w).cast("long").alias("n_rows"))


# ------------------------------------------------------------------ G10
def split_label(df: DataFrame, label_map: Mapping[str, str], dataset: str, target: str = "target") -> DataFrame:
    """Rename the dataset's label column to ``target`` (unknown dataset -> ValueError)."""
    if dataset not in label_map:
        raise ValueError(f"no label known for dataset {dataset!r}")
    lab = label_map[dataset]
    return df.withColumnRenamed(lab, target) if lab in df.columns else df
