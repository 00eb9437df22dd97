"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsift.llm import (bpe_tree, decontaminate, filter_audit, language_id, line_mph, packing, parity_join, quality_ledger,
                         quote_chat, secret_ledger, topk_search, toxicity_pu, whitening)
from rowsift.llm.common import held, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.train(docs.where(held(docs, "doc_id", 3) != 1))
    found = language_id.predict(docs, prototypes)
    return found.withColumn("held_out", held(found, "doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "cosine")


@query
def op2_quality_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_ledger.apply_policy(quality_ledger.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


@query
def op3_topk_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors["vec_id"] % 20 == 0, 20)


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_bpe_tree(spark, sf_dir):
    done = bpe_tree.encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op6_quote_chat(spark, sf_dir):
    return quote_chat.link(table(spark, sf_dir, "conversations"))


@query
def op7_line_dedup(spark, sf_dir):
    done = line_mph.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_parity_join(spark, sf_dir):
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_toxicity_pu(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_pu.train(docs, labels, F.crc32(F.col("id").cast("string")) % 5 != 0)
    found = toxicity_pu.score(docs, model)
    return found.select("doc_id", (held(found, "doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op10_secret_ledger(spark, sf_dir):
    found = secret_ledger.findings(table(spark, sf_dir, "documents"))
    n = lambda k, name: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long").alias(name)
    return found.select(F.col("path").alias("doc_id"), n(0, "n_assign"), n(1, "n_access"), n(2, "n_hex"),
                        F.sha2(F.encode(secret_ledger.spans_text(F.col("found"), only_base=True), "UTF-8"), 256).alias("base_sha256"),
                        secret_ledger.spans_text(F.col("found")).alias("spans"))


@query
def op11_decontamination(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_quality_ledger"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(list_filter(lines, lambda x: trim(x, {_BLANK}) <> '')) AS nl,
        len(list_distinct(list_filter(lines, lambda x: trim(x, {_BLANK}) <> ''))) AS ndl,
        len(lines) AS n_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
      FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, (nl - ndl)::BIGINT AS n_dup_lines,
        CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines > 3 AND 10 * (nl - ndl) > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END
        + CASE WHEN n_letters >= 40 AND 10 * n_upper > 6 * n_letters THEN 64 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
       bits::BIGINT AS fail_bits FROM f"""

ORACLES["op3_topk_search"] = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product([x::DOUBLE FOR x IN q.e], [x::DOUBLE FOR x IN c.e])::BIGINT AS score
      FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

_MARKS = r"^[ \t]*((?:>[ \t]*)+)"
ORACLES["op6_quote_chat"] = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT r, conv_id, turn, line, p, length(regexp_replace(regexp_extract(line, '{_MARKS}', 1), '[^>]', '', 'g')) AS lv,
        regexp_replace(trim(lower(regexp_replace(line, '{_MARKS}', '')), {_BLANK}), '[\x20\x09-\x0D]+', ' ', 'g') AS w
      FROM (SELECT *, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM m)),
g AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS run
      FROM (SELECT *, CASE WHEN lv = lag(lv, 1, -1) OVER (PARTITION BY r ORDER BY p) THEN 0 ELSE 1 END AS new FROM l)),
u AS (SELECT r, conv_id, turn, lv, unnest(list_distinct([string_agg(w, ' ' ORDER BY p)] || list(w))) AS u FROM g WHERE w <> '' GROUP BY r, conv_id, turn, lv, run),
o AS (SELECT conv_id, u, min(turn) AS f FROM u WHERE lv = 0 GROUP BY ALL),
b AS (SELECT r, u.conv_id, turn, f, row_number() OVER (PARTITION BY r ORDER BY lv, -length(u.u), f) AS k
      FROM u JOIN o ON o.conv_id = u.conv_id AND o.u = u.u WHERE lv > 0 AND f < turn),
e AS (SELECT conv_id, turn, min(f) AS up FROM b WHERE k = 1 GROUP BY ALL),
w AS (SELECT conv_id, turn, up AS thread, 1 AS depth FROM e UNION ALL SELECT w.conv_id, w.turn, e.up, depth + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.turn = w.thread),
x AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM w GROUP BY ALL),
y AS (SELECT DISTINCT conv_id, up AS turn, [up] AS way FROM e WHERE NOT EXISTS (SELECT 1 FROM e e2 WHERE e2.conv_id = e.conv_id AND e2.turn = e.up)
      UNION ALL SELECT e.conv_id, e.turn, list_append(way, e.turn) FROM y JOIN e ON e.conv_id = y.conv_id AND e.up = y.turn),
z AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, way[1] ORDER BY way) - 1 AS place FROM y),
q AS (SELECT r, (count(*) FILTER (lv > 0))::BIGINT AS n_quoted, coalesce(trim(string_agg(line, chr(10) ORDER BY p) FILTER (lv = 0), {_BLANK}), '') AS own FROM l GROUP BY r)
SELECT m.conv_id, coalesce(x.thread, m.turn) AS thread, coalesce(z.place, 0)::BIGINT AS place, coalesce(x.depth, 0)::BIGINT AS depth, m.turn, m.role, b.f AS reply_to, n_quoted,
       CASE WHEN n_quoted > 0 THEN own ELSE t END AS text,
       '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || CASE WHEN n_quoted > 0 THEN own ELSE t END || '<|end|>' || chr(10) AS formatted
FROM m JOIN q USING (r) LEFT JOIN b ON b.r = m.r AND b.k = 1 LEFT JOIN x ON x.conv_id = m.conv_id AND x.turn = m.turn
LEFT JOIN z ON z.conv_id = m.conv_id AND z.turn = m.turn"""

ORACLES["op7_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), {_LOW}) AS k FROM l),
r AS (SELECT k, min(doc_id) AS keep FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, p, line, keep IS NOT NULL AND keep <> k.doc_id AS lost FROM k LEFT JOIN r ON k.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

ORACLES["op8_parity_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
c AS (SELECT doc_id, doc_id AS x FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.x)::BIGINT AS component_id
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _secret_sql() -> str:
    """Matches and the gaps between them, per rule, as positions."""
    base = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]  # as the contract has them
    more = [(r.kind, r.pattern, r.part, r.least) for r in secret_ledger.MORE_RULES]
    parts = []
    for k, (kind, pattern, part, least) in enumerate(base + more):
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{pattern}') AS gaps,
            regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {part}) AS ps FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, k, kind, least, gaps, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
y AS (SELECT doc_id, k, kind, length(ps[i]) >= least AS good,
        list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(g) FOR g IN ms[1:i-1]]), 0) AS s, length(ms[i]) AS n FROM x),
z AS (SELECT doc_id, k, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span, s FROM y WHERE good)
SELECT d.doc_id, (count(*) FILTER (k = 0))::BIGINT AS n_assign, (count(*) FILTER (k = 1))::BIGINT AS n_access, (count(*) FILTER (k = 2))::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLES["op10_secret_ledger"] = _secret_sql()


ORACLES["op11_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p:p+least(len(w), 10)-1] AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
x AS (SELECT r, p, n, w[p:p+n-1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, p, x.n, item_id FROM x JOIN g ON g.n = x.n AND g.g = x.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

ORACLES["op13_filter_audit"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS fails
      FROM d JOIN first USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
o AS (SELECT '' AS o UNION ALL SELECT o || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE length(o) < 5 AND NOT contains(o, c)),
s AS (SELECT o AS filter_order, step, o[step] AS c, o[1:step-1] AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(o) = 5),
a AS (SELECT part, filter_order, step, c,
        sum(CASE WHEN translate(fails, before || c, '') = fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN g ELSE 0 END) AS good_lost,
        sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN x ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM a"""
