import random
import re
from collections import defaultdict

from rowsift.llm import parity_join as P
from rowsift.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(voc) for _ in range(n)]
    rows, base, passage = [], text(120), text(30)
    for k in range(90):  # near copies, some too far apart
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(voc)
        rows.append(" ".join(w))
    rows += [" ".join(text(r.randint(10, 60)) + passage) for _ in range(40)]
    rows += ["", " \n\t ", None, "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", "É b c d e", "é b c d e"]
    rows += [" ".join(text(r.randint(1, 12))) for _ in range(30)] + [" ".join(text(3000))] * 2 + [" ".join(base)] * 20
    for _ in range(10):
        w = text(r.randint(8, 15))
        rows += [" ".join(w), " ".join(w[:-1]), " ".join(w + ["x"])]
    r.shuffle(rows)
    return list(enumerate(rows, 5))


def test_components_equal_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in P.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (5, "A B C D E")], "doc_id long, text string")
    got = sorted(map(tuple, P.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 1, None), (3, 1, 3), (3, 1, 3), (4, 0, 4), (5, 1, 3)], key=str)


def test_bounds():
    import numpy as np
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        keep = a[r.random(len(a)) < r.choice([0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if not len(b):
            continue
        apart = len(np.setxor1d(a, b))
        ham = P.hamming(*(np.frombuffer(P.dense_sketch(x), np.uint8) for x in (a, b)))
        assert ham <= apart
        both = len(np.intersect1d(a, b))
        if 4 * both >= 3 * (len(a) + len(b) - both):
            assert apart <= P.differ(len(a)) and apart <= P.differ(len(b))
            assert len(np.intersect1d(P.keys_of(a, None), P.keys_of(b, None)))


def test_chain_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(lambda: None, {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100})
    assert all(got[k] == want[k] for k in want)


def test_wide_sketches(spark):
    """Texts whose dense sketches are wider than the folded ones: near copies on both sides of the threshold."""
    r = random.Random(11)
    voc = [f"w{k}" for k in range(5000)]
    rows = []
    for n in (700, 1500, 2600):
        base = [r.choice(voc) for _ in range(n)]
        for share in (0, 0.01, 0.02, 0.025, 0.03, 0.035, 0.05):
            w = list(base)
            for k in r.sample(range(n), int(share * n)):
                w[k] = "x" + w[k]
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in P.near_duplicates(docs).collect()}
    assert got == brute(rows)
