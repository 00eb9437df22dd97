"""The audit against a document-by-document run of all orders."""
import re
from collections import Counter, defaultdict
from itertools import permutations

from rowsift.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, part string, n int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    least = {}
    for r in docs:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = defaultdict(Counter)
    for r in docs:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, c in enumerate(order):
                cell = out[r[2] or "", order, k + 1]
                cell["unique_fails"] += fails[c] and sum(fails.values()) == 1
                cell["redundant"] += fails[c] and gone
                if fails[c] and not gone:
                    gone = True
                    cell["removed"] += 1
                    cell["good_lost"] += r[0] in good
                    cell["toxic_lost"] += r[0] in toxic
                cell["kept"] += not gone
    shapley = Counter()
    for (part, order, k), cell in out.items():
        shapley[part, order[k - 1]] += cell["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *(cell[c] for c in names), shapley[key[0], key[1][key[2] - 1]]) for key, cell in out.items())


def test_audit(spark, monkeypatch):
    long = " ".join(f"word{k}" for k in range(250))
    texts = [long, long.upper(), "short", "Short # mark", long + " $", "same " * 300, "SAME " * 300, None, "", "  \n", "naïve Ünïcode *", long + " x", "漢 " * 210]
    docs = [(k, texts[k % len(texts)], [None, "", "a", "b"][k % 4], "z", 1, "q") for k in range(60)]
    docs += [(5, "other text of one id", "a", None, None, None), (7, texts[7 % len(texts)], "b", None, 0, None)] + [(None, long, "a", None, 0, None)] * 3 + [(61, long, "c", None, 0, None)] * 4
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 50, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)]
    d = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    want = brute(docs, [(i, q, t) for i, q, t in labels if i is not None])
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for share in (1000, 1):  # all copies met by broadcast, then all by a shuffle join
        monkeypatch.setattr(fa, "HOT_SHARE", share)
        assert sorted(tuple(r) for r in fa.audit(d, lab).select(*names).collect()) == want
    assert fa.audit(d.limit(0), lab).count() == 0
    none = fa.audit(d, lab.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(none) == (0, 0)


def test_ids_move_once(spark):
    """The sets are unrolled behind the exchange of the ids, and no join is a product of rows."""
    d = spark.createDataFrame([(k, "a b", "s", "", 1, "") for k in range(50)], SCHEMA)
    units = fa.units(d)
    plan = fa.survivors(units, fa.fail_tables(units))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression") and "Cartesian" not in plan
