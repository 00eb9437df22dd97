"""Decontamination against a plain search for every window, and its edge cases."""
import random
import re

from rowsift.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, _dc_text string, n_words string, items int"
ITEMS = "item_id long, text string, words int"


def norm(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    """(words, hit word numbers, ids as strings)"""
    words, hit, names = norm(text), set(), set()
    for item, t in items:
        w = norm(t)
        n = min(len(w), 10)
        grams = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1 if n else 0):
            if tuple(words[p:p + n]) in grams:
                hit.update(range(p, p + n))
                if item is not None:
                    names.add(str(item))
    return words, hit, sorted(names)


def planted():
    rng = random.Random(5)
    words = ["Alpha", "beta", "Ärger", "go", "x1", "déjà", "Zed", "Ünder", "漢字", "a"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "…  ".encode().decode(), "."]) for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 40]))) for k in range(12)] + [(None, text(30)), (3, text(25)), (50, ""), (51, None), (52, "..."), (53, text(2500))]
    items += [(60, items[4][1]), (61, items[4][1].upper())]
    docs = [(k, text(rng.choice([0, 1, 5, 30, 200])), "c", None, 3) for k in range(30)]
    for k, (_, t) in enumerate(items):
        docs.append((100 + k, text(20) + " | " + (t or "") + " | " + text(20), None, "q", 1))
        docs.append((200 + k, (t or "")[: len(t or "") // 2], None, None, None))
    return docs + docs[-3:] + [(None, items[4][1], None, None, 0), (7, None, None, None, 0), (8, "", None, None, 0), (9, "word " * 40_000 + (items[9][1] or ""), None, None, 0)], items


def test_scan_is_the_plain_search(spark):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    want = sorted((str(r[0]), len(w), len(h), n) for r in docs for w, h, n in [brute(r[1], items)])
    for limit in (dc.BLOCK_BYTES, 3000):  # one block, and many
        found = dc.scan(d, b, limit=limit).select("doc_id", "n_words", dc.n_hit().alias("n"), "items").collect()
        assert sorted((str(r[0]), r[1], r[2], r[3]) for r in found) == want
    pieces = dc.normalised(b)
    assert dc.blocks(pieces, 3000)[1] > 1 and pieces.where("size(split(words, ' ')) > 1009").count() == 0


def test_spans_are_removed(spark):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    rows = dc.remove(d, b).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() == dict.fromkeys(d.columns).keys()
    texts = {str(r["doc_id"]): r["text"] for r in rows}
    for r in docs:
        words, hit, _ = brute(r[1], items)
        assert norm(texts[str(r[0])]) == [w for k, w in enumerate(words) if k not in hit] or r[0] in {x[0] for x in docs[-7:]}
        if not hit and r[0] is not None:
            assert texts[str(r[0])] == r[1] or r[0] in (7, 8, 9)
    clean = {str(r[0]) for r in docs if not brute(r[1], items)[1]}
    assert {str(r["doc_id"]) for r in dc.remove(d, b, how="documents").collect()} >= clean


def test_equal_hashes_do_not_count(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(dc, "_mix", lambda x: x & np.uint64(1))  # nearly every window collides
    index = dc.Index([("1", "one two three four five six seven eight nine ten eleven"), ("2", "a b")])
    raw, ends = dc._texts(pa.array(["one two three four five six seven eight nine TEN", "b a a b", "x y z"]))
    w, hit, items = index.scan(raw, ends)
    assert hit.tolist() == [True] * 10 + [False, False, True, True] + [False] * 3 and items == {0: {"1"}, 1: {"2"}}


def test_long_words_and_steps(monkeypatch):
    import pyarrow as pa

    texts = ["ab" * 300 + " cd ef", "", None, "gh" + " " * 50 + "ij", "kl"]
    whole = dc.Words(*dc._texts(pa.array(texts))).hash.tolist()
    monkeypatch.setattr(dc, "STEP", 7)
    assert dc.Words(*dc._texts(pa.array(texts))).hash.tolist() == whole and len(set(whole)) == 6


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c", None, None, 1)], SCHEMA), spark.createDataFrame([(1, "b", 0)], ITEMS)
    assert [tuple(r) for r in dc.scan(d, b.limit(0)).select("n_words", "spans", "items").collect()] == [(3, [], [])]
    assert dc.scan(d.limit(0), b).count() == 0 and dc.remove(d, b).first()["text"] == "a   c"
