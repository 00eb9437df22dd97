"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores measurements and one failure bit
per rule. A ``Policy`` is a versioned set of bits that reject; ``apply_policy`` turns a ledger
into verdicts by one bitwise and, ``ablations`` counts for each rule what the policy would do
without it, from the histogram of failure bits. Texts are never read again after the ledger.

The ledger is one narrow projection: no shuffle, no Python. Ablations aggregate by the bit
pattern (at most 2 ** rules groups, partial aggregates first), so a hot source or a group of
copies costs nothing extra.

Defined results: a null or empty text has no words (all measurements 0) and fails ``few_words``;
a null id is kept as null; equal rows give equal rows; an empty table gives an empty ledger;
other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import BLANK_RUN, BLANKS, LOWER, UPPER, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ascii_letters")

#: Rule name -> failing condition over the measurements; the place in the list is its bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("shouting", "n_ascii_letters >= 40 AND 10 * n_upper > 6 * n_ascii_letters"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_words"))
DEFAULT = Policy("default-1", tuple(name for name, _ in RULES))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more in the array."""

    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))

    def covered(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), by_hash))

    def by_hash(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda n, x: n + x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def measurements(text: Column) -> Column:
    """Struct of ``MEASURES``."""
    t = F.coalesce(text, F.lit(""))
    blank = F.lit(BLANKS)
    words = F.filter(F.split(t, BLANK_RUN, -1), lambda w: w != "")
    lines = F.split(t, "\n", -1)
    as_long = lambda c, name: c.cast("long").alias(name)
    by_words = let(words, lambda w: F.struct(as_long(F.size(w), "n"), as_long(repeated_words(w), "rep")))
    by_lines = let(F.filter(lines, lambda x: F.trim(x, blank) != ""),
                   lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(F.struct(t.alias("t"), by_words.alias("w"), by_lines.alias("d"), F.size(lines).alias("nl")), lambda s: F.struct(
        s["w"]["n"].alias("n_words"),
        as_long(F.length(F.translate(s["t"], BLANKS, "")), "word_chars"),
        as_long(F.length(s["t"]) - F.length(F.translate(s["t"], SYMBOLS, "")), "n_symbols"),
        as_long(s["d"], "n_dup_lines"),
        s["w"]["rep"].alias("n_repeat_words"),
        as_long(s["nl"], "n_lines"),
        as_long(F.length(s["t"]) - F.length(F.translate(s["t"], UPPER, "")), "n_upper"),
        as_long(F.length(s["t"]) - F.length(F.translate(s["t"], UPPER + LOWER, "")), "n_ascii_letters")))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` (bit k set: rule k failed)."""
    m = docs.select(docs[id_col].alias("doc_id"), measurements(docs[text_col]).alias("m")).select("doc_id", "m.*")
    bits = F.lit(0).cast("long")
    for k, (_, failing) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("fail_bits", bits)


def stored(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written to ``path`` and read back: policies and ablations of later versions start from here."""
    ledger(docs, id_col, text_col).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and ``policy_version``."""
    return (entries
            .withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0)
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE.mask).cast("long")) == 0)
            .withColumn("policy_version", F.lit(policy.version)))


def ablations(entries: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: n_failed, n_failed_alone (kept if only this rule were left out)
    and n_kept_without. The base rules reject under every policy, as in ``apply_policy``, unless the rule left
    out is one of them. From the counts per bit pattern, not from the documents again."""
    patterns = (entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE.mask).cast("long")).alias("bits"))
                .agg(F.count(F.lit(1)).alias("n")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    one = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        hit(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        hit(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        hit(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"))
