"""Secret scans by an incremental blob ledger (DataFrame functions only).

Every version of every text is content-addressed (``blob`` = SHA-256 of its UTF-8 bytes). The ledger
has one row per scan of a blob: the ids of the rules run (kind and version) and the spans that they
found, also none. ``update`` scans only the pairs of blob and rule version that the ledger doesn't
hold; ``findings`` updates a ledger, or an empty one, and joins all its findings back to every path
(documents, file versions) that holds the blob.

Scale: a blob is scanned once, however many copies there are (copies collapse in the map-side
part of ``dropDuplicates``). One shuffle carries each distinct unseen text, the others only addresses
and spans. The ledger is a table in the shared folder, so the last join has a plain exchange on
both sides and a blob with very many paths can be split by the adaptive skew join.

Defined results: a null text is scanned as the empty text; a null path stays a row with a null
path; repeated rows stay repeated; an empty table gives an empty result; other columns of the
input are ignored. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowsift.llm.common import let
from rowsift.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group ``part`` has ``least`` code points. A text without
    any of ``hints`` (looked up in the lower-cased text) isn't searched with the pattern."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1


#: The three base kinds, in this order. A run of 24 or more hex digits is found
#: directly: a longest run of fewer never counts and matches never overlap runs.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6,
         ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds, listed after the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{20,}", 0, 1, ("xox",)),
    Rule("login", r"[a-z][a-z0-9+.-]{1,12}://[^\s/:@]+:[^\s/:@]{3,}@", 0, 1, ("://",)),
)
RULES = BASE_RULES + MORE_RULES


def rule_id(rules: tuple[Rule, ...]) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def paths(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, text (null: empty) and blob of every version."""
    return versions.select(versions[path_col].alias("path"), F.coalesce(versions[text_col], F.lit("")).alias("text")) \
        .withColumn("blob", F.sha2("text", 256))


def unseen(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """One row per distinct blob with the ids of the rules not yet run on it; blobs with none go."""
    ids = rule_id(rules)
    new = blobs.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        return new.withColumn("todo", F.array(*map(F.lit, ids)))
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))  # one row per scan of a blob
    return (new.join(done, "blob", "left")
            .withColumn("todo", F.array_except(F.array(*map(F.lit, ids)), F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0).drop("done"))


def _pieces(rule: Rule, k: int) -> Column:
    """Array of (k, n, gap, size, good) for the matches of one rule: ``gap`` code points lie between
    the match before (or the text's start) and this one."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    part = whole if rule.part == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.part)), lambda m: F.length(m))
    rows = let(F.struct(gaps.alias("g"), whole.alias("w"), part.alias("p")), lambda s: F.transform(
        s["w"], lambda w, i: F.struct(F.lit(k).alias("k"), i.alias("n"), F.get(s["g"], i).alias("gap"), w.alias("size"),
                                      (F.get(s["p"], i) >= rule.least).alias("good"))))
    none = F.array().cast("array<struct<k:int,n:int,gap:int,size:int,good:boolean>>")
    wanted = F.array_contains("todo", f"{rule.kind}@{rule.version}")
    if rule.hints:
        hint = F.lit(False)
        for h in rule.hints:
            hint = hint | F.contains(F.col("small"), F.lit(h))
        wanted = wanted & hint
    return F.when(wanted & F.col("text").rlike(rule.pattern), rows).otherwise(none)


_SPANS = "array<struct<rule:string,start:bigint,end:bigint>>"


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger entries: blob, rules (ids of those run), spans (array of rule, start, end), one row per row of
    ``todo`` (blob, text, todo), also where nothing is found."""
    found = F.flatten(F.array(*[_pieces(r, k) for k, r in enumerate(rules)]))
    scanned = cut_lineage(todo.withColumn("small", F.lower("text")).select("blob", "todo", found.alias("found")), "secret-scan")
    hits = scanned.where(F.size("found") > 0)
    rows = hits.select("blob", F.explode("found").alias("f")).select("blob", "f.*")
    upto = Window.partitionBy("blob", "k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spans = (rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
             .where("good").withColumn("start", F.col("end") - F.col("size")))
    names = F.array(*map(F.lit, rule_id(rules)))
    by_blob = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(F.col("start"), F.col("k"), F.col("end")))).alias("s"))
    none = F.array().cast(_SPANS)
    marked = F.transform("s", lambda s: F.struct(F.get(names, s["k"]).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    with_hits = hits.select("blob", F.col("todo").alias("rules")).join(by_blob, "blob", "left").select("blob", "rules", F.coalesce(marked, none).alias("spans"))
    return with_hits.unionByName(scanned.where(F.size("found") == 0).select("blob", F.col("todo").alias("rules"), none.alias("spans")))


def update(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
           path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written ledger (blob, rules, spans) after scanning what it lacks; every scanned pair has an entry,
    so the next call skips it."""
    new = scan(unseen(paths(versions, path_col, text_col), rules, ledger), rules)
    return cut_lineage(new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new), "secret-ledger")


def findings(versions: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text",
             ledger: DataFrame | None = None) -> DataFrame:
    """path, blob, found (array of start, k, end sorted by start, then rule) of every version: the ledger is brought up
    to date for ``rules``, then all its findings of these rules are joined to all paths."""
    return lookup(versions, update(versions, rules, ledger, path_col, text_col), rules, path_col, text_col)


def lookup(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``findings`` of a ledger as it is."""
    kinds = F.array(*map(F.lit, rule_id(rules)))
    place = lambda s: (F.array_position(kinds, s["rule"]) - 1).cast("int")
    mine = F.filter("spans", lambda s: F.array_contains(kinds, s["rule"]))
    held = ledger.select("blob", F.transform(mine, lambda s: F.struct(s["start"].alias("start"), place(s).alias("k"), s["end"].alias("end"))).alias("f"))
    by_blob = held.where(F.size("f") > 0).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias("found"))  # the scans of one blob
    by_blob = cut_lineage(by_blob, "secret-findings")
    at = paths(versions, path_col, text_col)
    return at.select("path", "blob").join(by_blob, "blob", "left").select(
        "path", "blob", F.coalesce("found", F.array().cast("array<struct<start:bigint,k:int,end:bigint>>")).alias("found"))


def spans_text(found: Column, rules: tuple[Rule, ...] = RULES, only_base: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(found, lambda s: s["k"] < len(BASE_RULES)) if only_base else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"),
                                                                s["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every stretch covered by spans replaced by ``mark``."""
    joined = F.aggregate(found, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    rebuilt = let(joined, lambda m: F.concat(
        F.array_join(F.transform(m, lambda s, i: F.concat(F.substring(
            text, (F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1).cast("int"),
            (s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))).cast("int")), F.lit(mark))), ""),
        F.substring(text, (F.element_at(m, -1)["end"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, rebuilt).otherwise(text)
