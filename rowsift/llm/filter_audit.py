"""Filter interaction audit with failing-id relations.

1. ``units`` reads every text once: id, a hash of the text, part, the filters that look at one text,
   and how many equal rows there are. The repeat filter compares each unit with the smallest id that
   holds its text.
2. One id table per filter holds the units that fail it (``fails``, written with one folder per filter).
3. For every set of filters that can stand before a step, left-anti joins of units and failing ids with
   the id tables give the survivors and the removals, a left-semi join the redundancies (failed, but
   removed earlier); failing ids are semi-joined with the labelled ids for the label losses.
4. What a step removes depends on the set before it, not on its order, so the counts per part, set and
   filter (a small table) are dealt to the positions of all orders.

Scale: texts are read once and never shuffled. Ids are partitioned by key once; the sets are unrolled
behind that exchange and the joins work in place, so that the shuffle holds each id once, not once per
set. The counts are aggregated before they move. Copies of a text are met by a broadcast if they
are more than a thousandth of all units (so a thousand texts at most), by a shuffle join otherwise;
equal rows are one unit with a count, so no key is hot.

Defined results: a null text is the empty text; a null part counts as the empty one; a null id has
no label, and its text is no repeat and makes none; rows with one id but different texts are different
units; a repeated label row counts once (1 if any row says 1); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import BLANK_RUN, UPPER, let
from rowsift.session import cut_lineage, scratch_path

HOT_SHARE = 1000


@dataclass(frozen=True)
class Filter:
    """A letter and a failing condition over the column ``m`` (measurements); None: the text is held by a smaller id."""

    letter: str
    failing: str | None


#: The filters, in the order in which subsets name them.
FILTERS = (
    Filter("A", "m.words < 200"),
    Filter("B", "100 * m.distinct < 50 * m.words"),
    Filter("C", "100 * m.capitals > 2 * m.chars"),
    Filter("D", "m.marks"),
    Filter("E", None),
)
#: Fixed value: the characters that filter D looks for.
MARKS = r"[#$%&*|]"


def measurements(text: Column) -> Column:
    """words, distinct (words), capitals (A-Z), chars (code points), marks (holds one of ``MARKS``)."""
    words = F.filter(F.split(text, BLANK_RUN, -1), lambda w: w != "")
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    chars = F.length(text)
    return let(F.struct(by_words.alias("w"), chars.alias("c"), F.length(F.translate(text, UPPER, "")).alias("low"), text.rlike(MARKS).alias("marks")),
               lambda s: F.struct(s["w"]["n"].alias("words"), s["w"]["d"].alias("distinct"), (s["c"] - s["low"]).alias("capitals"),
                                  s["c"].alias("chars"), s["marks"].alias("marks")))


def units(docs: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The written table of id, h (hash of the text), sha, part, n (equal rows) and fails (letters, without the repeat filter)."""
    at = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                     F.coalesce(docs[text_col], F.lit("")).alias("text"))
    at = at.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), measurements(F.col("text")).alias("m"))
    fails = F.concat(F.lit(""), *[F.when(F.expr(f.failing), F.lit(f.letter)).otherwise(F.lit("")) for f in filters if f.failing])
    at = at.select("id", "part", "sha", fails.alias("fails")).groupBy("id", "sha", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(at.select("id", F.xxhash64("sha", F.col("id").isNull()).alias("h"), "sha", "part", "fails", "n"), "audit-units")


def repeats(all_units: DataFrame) -> DataFrame:
    """The units whose text a smaller id holds."""
    with_id = all_units.where(F.col("id").isNotNull())
    copies = with_id.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("k")).where("least < most")
    copies = cut_lineage(copies.select(F.col("sha").alias("c_sha"), "least", "k"), "audit-copies")
    hot = all_units.count() // HOT_SHARE + 1
    many = F.broadcast(copies.where(F.col("k") > hot))  # at most HOT_SHARE texts hold more than a share of all units
    same = lambda c: (with_id["sha"] == c["c_sha"]) & (with_id["id"] > c["least"])
    few = copies.where(F.col("k") <= hot)
    rest = with_id.join(many, with_id["sha"] == many["c_sha"], "left_anti")
    return with_id.join(many, same(many), "left_semi").unionByName(rest.join(few, (rest["sha"] == few["c_sha"]) & (rest["id"] > few["least"]), "left_semi"))


def fail_tables(all_units: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """The written id tables (letter, id, h, part, n), one folder per letter."""
    key = ["id", "h", "part", "n"]
    tables = None
    for f in filters:
        ids = (all_units.where(F.contains("fails", F.lit(f.letter))) if f.failing else repeats(all_units)).select(F.lit(f.letter).alias("letter"), *key)
        tables = ids if tables is None else tables.unionByName(ids)
    path = scratch_path(all_units.sparkSession, "audit-fails")
    tables.write.partitionBy("letter").parquet(path)
    return all_units.sparkSession.read.schema(tables.select(*key, "letter").schema).parquet(path)


def _subsets(letters: str) -> list[str]:
    return ["".join(c) for k in range(len(letters) + 1) for c in combinations(letters, k)]


def _keyed(df: DataFrame) -> DataFrame:
    """Partitioned by key before anything is unrolled; a null id takes part under its own hash."""
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))).repartition("id", "h")


def _before(failing: DataFrame, left: DataFrame) -> Column:
    return (left["id"] == failing["f_id"]) & (left["h"] == failing["f_h"]) & F.contains(left["before"], failing["f_letter"])


def survivors(all_units: DataFrame, fails: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """part, before (a set of filters), rows: how many documents none of them removes. Left-anti."""
    letters = "".join(f.letter for f in filters)
    left = _keyed(all_units.select("id", "h", "part", "n")).withColumn("before", F.explode(F.array(*map(F.lit, _subsets(letters)))))
    failing = _keyed(fails).select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), F.col("letter").alias("f_letter"))
    return left.join(failing, _before(failing, left), "left_anti").groupBy("part", "before").agg(F.sum("n").alias("rows"))


def steps(fails: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, label_id: str = "doc_id") -> DataFrame:
    """part, letter, before (a set of other filters), removed, redundant, good_lost, toxic_lost: what the filter
    does after that set. Left-anti for removals and losses, left-semi for redundancies and labelled ids."""
    letters = "".join(f.letter for f in filters)
    kinds = fails.withColumn("kind", F.lit("removed"))
    for kind, column in (("good_lost", "quality"), ("toxic_lost", "toxic")):
        ids = labels.where((labels[column] == 1) & labels[label_id].isNotNull()).select(labels[label_id].alias("l_id")).distinct()
        kinds = kinds.unionByName(fails.join(ids, fails["id"] == ids["l_id"], "left_semi").withColumn("kind", F.lit(kind)))
    others = F.lit(None)
    for f in filters:
        sets = F.array(*map(F.lit, _subsets(letters.replace(f.letter, ""))))
        others = F.when(F.col("letter") == f.letter, sets).otherwise(others)
    left = _keyed(kinds).withColumn("before", F.explode(others))
    failing = _keyed(fails).select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), F.col("letter").alias("f_letter"))
    gone = left.where("kind = 'removed'").join(failing, _before(failing, left), "left_semi").withColumn("kind", F.lit("redundant"))
    found = left.join(failing, _before(failing, left), "left_anti").unionByName(gone)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    return found.groupBy("part", "letter", "before").agg(*map(total, ("removed", "redundant", "good_lost", "toxic_lost")))


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source", label_id: str = "doc_id") -> DataFrame:
    """One row per part, filter_order (every order of the letters) and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (all of the part)."""
    letters = "".join(f.letter for f in filters)
    all_units = units(docs, filters, id_col, text_col, part_col)
    fails = fail_tables(all_units, filters)
    kept = survivors(all_units, fails, filters)
    done = cut_lineage(steps(fails, labels, filters, label_id), "audit-steps")
    in_order = lambda s: "".join(sorted(s, key=letters.index))
    orders = ["".join(p) for p in permutations(letters)]
    places = [(o, k + 1, o[k], in_order(o[:k]), in_order(o[:k + 1])) for o in orders for k in range(len(o))]
    grid = docs.sparkSession.createDataFrame(places, "filter_order string, step int, letter string, before string, after string")
    parts = all_units.select("part").distinct()
    # what each filter does over all orders: the number of orders in which a set stands before it is fixed
    spread = grid.groupBy("letter", "before").agg(F.count(F.lit(1)).alias("orders"))
    share = done.join(F.broadcast(spread), ["letter", "before"]).groupBy("part", "letter").agg(
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
        F.sum(F.when(F.length("before") == len(letters) - 1, F.col("removed")).otherwise(0)).alias("unique_fails"))
    cells = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(x).alias("letter"), F.lit(b).alias("before"), F.lit(a).alias("after"))
                      for o, s, x, b, a in places])
    out = (parts.select("part", F.explode(cells).alias("c")).select("part", "c.*")
           .join(done, ["part", "letter", "before"], "left").join(share, ["part", "letter"], "left")
           .join(kept.withColumnRenamed("before", "after").withColumnRenamed("rows", "kept"), ["part", "after"], "left"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", "step", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names])
