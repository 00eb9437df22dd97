"""``corpus_pipeline.run`` on planted documents against a plain version of every stage."""
import random
import re

import corpus_pipeline
from rowsift.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = {"en": ["the", "house", "with", "river", "thing", "would", "their", "shade", "wither", "another", "which", "thought"],
         "de": ["und", "haus", "schluss", "zwischen", "fluss", "nicht", "schatten", "werden", "durch", "gebirge", "sprache", "kraft"]}


def planted():
    rng = random.Random(11)
    word = lambda lang: rng.choice(STEMS[lang]) + rng.choice(["", "s", "en", "er", "ing"] if lang == "en" else ["", "e", "en", "ung", "lich"])
    text = lambda lang, n: " ".join(word(lang) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))
    docs = [(k, text("en" if k % 2 else "de", rng.randint(60, 300)), "en" if k % 2 else "de") for k in range(120)]
    passage = "A passage of license text that many of these documents share word for word"
    docs = [(k, t + (f"\n{passage}\n" + text(lang, 9) if k % 10 == 3 else ""), lang) for k, t, lang in docs]
    for k in range(8):  # exact and near copies
        docs.append((200 + k, docs[k][1], docs[k][2]))
        near = docs[20 + k][1].replace("\n", " ").split()
        near[len(near) // 2] = "changed"
        docs.append((300 + k, " ".join(near), docs[20 + k][2]))
    docs += [(400 + k, docs[60 + k][1] + " AKIA" + "ABCD1234" * 3 + " " + text(docs[60 + k][2], 120), docs[60 + k][2]) for k in range(4)]
    docs += [(500 + k, "".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") + (" " if rng.random() < 0.2 else "") for _ in range(3000)), None) for k in range(5)]
    return docs + [(600, None, "en"), (601, "", "en"), (602, "12 34 56 !", "en"), (603, text("en", 5000), "en")]


def without_lines(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in docs.items():
        for k in {key(x) for x in t.split("\n")}:
            first.setdefault(k, set()).add(i)
    out = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or i == min(first[key(x)])) for i, t in docs.items()}
    return {i: t for i, t in out.items() if WORD.search(t)}


def without_copies(docs):
    shingles = {}
    for i, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        shingles[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in docs:
        for j in docs:
            if i < j and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def test_run(spark):
    docs = planted()
    folder = scratch_path(spark, "planted")
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    letters = {i: t for i, t, _ in docs if t and re.search("[a-zäöü]", t.lower())}
    want = without_copies(without_lines(letters))
    sizes = {i: len(WORD.findall(t)) for i, t in want.items()}
    assert len(docs) > len(letters) > len(want) + 8
    got, bins = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["size"]))
    assert got == sizes
    for content in bins.values():
        content.sort()
        assert all(a[0] + a[1] <= b[0] for a, b in zip(content, content[1:])) and content[-1][0] + content[-1][1] <= 2048


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choice(STEMS["en"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(4))
    near = a.split()
    near[30] = "changed"
    rows = [(5, a), (5, b), (5, b), (7, " ".join(near)), (None, b), (None, c), (None, c), (8, d), (8, d), (3, d), (9, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(3, d), (5, a), (5, b), (9, None), (None, c)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
