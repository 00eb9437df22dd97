"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts, labelled or not, are only unlabelled
examples. A linear classifier over the words and word beginnings that a text holds (those that
positives hold significantly more often than unlabelled texts, and at least LEAST_LIFT times as
often: significance alone admits ever more common words as the table grows) is fitted in numpy by the
class-prior-corrected risk  p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))  with the
logistic loss; where the bracket is negative, its gradient is turned round so that the
classifier stops gaining from unlabelled examples it has memorised. The prior p is the share of
toxic rows among the labelled rows given to ``train``.

Positives are a sample of at most ``positives`` confirmed texts, taken by the hash of the id (the
bound on labelled rows). Unlabelled are all texts of the usable ids: a first pass over them counts
the words that positives hold, a second one reduces each text to the chosen features it holds.
Texts with the same features have the same loss and gradient, so the risk over all texts is a
sum over distinct feature sets with weights, and only those are fitted. If the sets hold more than
``ENTRIES`` features (32 MB), the sums of each step are taken by Spark over the table of sets instead;
the result is the same. Scoring is one narrow map, with the chosen features shipped along.

Defined results: a null text is scored as the empty text; without a confirmed toxic row every
score is 0; null ids are never trained on but are scored; repeated rows stay; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import text_slices
from rowsift.session import cut_lineage

POSITIVES = 4000
ENTRIES = 8_000_000
MIN_TEXTS = 4
LEAST_Z = 4.0
LEAST_LIFT = 2.0
START = 5
STEPS = 300
RATE = 0.05
DECAY = 1e-4
#: Fixed value: what is taken off the ends of a word.
EDGES = b".,;:!?\"'()[]{}<>*_|-"


def words(text: str | None) -> set[bytes]:
    return {w.strip(EDGES) for w in (text or "").lower().encode().split()} - {b""}


def features(word: bytes) -> tuple[int, int]:
    """Hashes of a word and of its first letters (marked, so that they never equal a word)."""
    return _hash(word), _hash(word.decode()[:START].encode() + b" ")


def chosen(in_p: np.ndarray, n_p: float, in_u: np.ndarray, n_u: float) -> np.ndarray:
    """Whether each feature is held significantly more often by positives (two-proportion z), and at least LEAST_LIFT times as often."""
    both = (in_p + in_u) / (n_p + n_u)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    return (in_p >= MIN_TEXTS) & (z >= LEAST_Z) & (in_p * n_u >= LEAST_LIFT * in_u * n_p)


class Sets:
    """Distinct feature sets (``sets``: an Arrow list array of feature numbers) with the share of positives and of unlabelled texts that have each."""

    def __init__(self, sets: pa.Array, of_p: np.ndarray, of_u: np.ndarray, width: int):
        offsets = sets.offsets.to_numpy()
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        self.place = sets.values.to_numpy()[offsets[0]:offsets[-1]]
        order = np.argsort(self.place, kind="stable")
        self.owner_by_place = owner[order]  # for the gradient: the sets of each feature, one after the other
        counts = np.bincount(self.place, minlength=width)
        self.some, self.begins = np.flatnonzero(sizes), (offsets[:-1] - offsets[0])[sizes > 0]
        self.used, self.starts = np.flatnonzero(counts), (np.cumsum(counts) - counts)[counts > 0]
        self.of_p, self.of_u, self.width = of_p, of_u, width

    def losses(self, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
        """(bracket, and per set the derivatives by its score of the positives' risk and of the bracket)."""
        f = np.full(len(self.of_p), b)
        if len(self.some):
            f[self.some] += np.add.reduceat(w[self.place], self.begins)
        sig, soft = 1 / (1 + np.exp(-np.clip(f, -30, 30))), np.logaddexp(0, f)  # soft: the loss of calling it negative
        return float(soft @ (self.of_u - prior * self.of_p)), -(1 - sig) * prior * self.of_p, sig * (self.of_u - prior * self.of_p)

    def spread(self, g: np.ndarray) -> np.ndarray:
        """The gradient by the weights, then by the bias, from derivatives by the scores."""
        out = np.zeros(self.width + 1)
        if len(self.used):
            out[self.used] = np.add.reduceat(g[self.owner_by_place], self.starts)
        out[-1] = g.sum()
        return out

    def gradient(self, w: np.ndarray, b: float, prior: float) -> np.ndarray:
        """Of the non-negative risk: both parts, or away from the bracket where it is negative."""
        rest, up, down = self.losses(w, b, prior)
        return self.spread(up + down if rest >= 0 else -down)


def fit(gradient, width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on the non-negative risk; ``gradient(w, b, prior)`` is as ``Sets.gradient``."""
    w = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    decay = np.append(np.full(width, DECAY), 0.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w[:-1], float(w[-1]), prior) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _held(known: set[int]):
    """text -> sorted hashes of its features among ``known``; each word is hashed once per task."""
    cache: dict[bytes, tuple[int, ...]] = {}

    def run(text: str | None) -> list[int]:
        found: set[int] = set()
        for w in words(text):
            if (hits := cache.get(w)) is None:
                if len(cache) > 200_000:
                    cache.clear()
                hits = cache[w] = tuple(h for h in features(w) if h in known)
            if hits:
                found.update(hits)
        return sorted(found)
    return run


def _count_all(batches):
    """(feature, number of texts) of the positives' texts."""
    total: dict[int, int] = {}
    for batch in text_slices(batches, 2048):
        for t in batch.column("text").to_pylist():
            for h in {h for w in words(t) for h in features(w)}:
                total[h] = total.get(h, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])


def _count_known(shared):
    def run(batches):
        names = shared.value
        held, total = _held(set(names.tolist())), np.zeros(len(names), np.int64)
        for batch in text_slices(batches, 2048):
            for t in batch.column("text").to_pylist():
                if hits := held(t):
                    total[np.searchsorted(names, hits)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["feature", "n"])
    return run


def _sets(names: np.ndarray):
    def run(batches):
        held = _held(set(names.tolist()))
        for batch in text_slices(batches, 2048):
            sets = [np.searchsorted(names, held(t)).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(sets, pa.list_(pa.int32()))], names=["positive", "features"])
    return run


def _spark_gradient(table: DataFrame, n_p: float, n_u: float, width: int):
    """``Sets.gradient`` over a table of sets, added up by Spark."""
    def gradient(w, b, prior):
        def run(batches):
            rest, up, down = 0.0, np.zeros(width + 1), np.zeros(width + 1)
            for batch in batches:
                of_p, of_u = (batch.column(c).to_numpy() / n for c, n in (("p", n_p), ("u", n_u)))
                sets = Sets(batch.column("features"), of_p, of_u, width)
                one, by_p, by_u = sets.losses(w, b, prior)
                rest, up, down = rest + one, up + sets.spread(by_p), down + sets.spread(by_u)
            yield pa.RecordBatch.from_arrays([pa.array([rest]), pa.array([up.tolist()]), pa.array([down.tolist()])], names=["rest", "up", "down"])

        parts = table.mapInArrow(run, "rest double, up array<double>, down array<double>").collect()  # one row per task
        up, down = (np.sum([r[c] for r in parts], axis=0) for c in ("up", "down"))
        return up + down if sum(r["rest"] for r in parts) >= 0 else -down
    return gradient


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "toxic", positives: int = POSITIVES, entries: int = ENTRIES):
    """(word hashes, weights, bias), or None without a positive. ``usable``: over the id, named ``id``."""
    known = labels.select(labels[label_id].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(usable)
    share = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    if not share["p"]:
        return None
    prior = min(0.9, max(1e-3, share["p"] / share["n"]))
    sample = known.where("y = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(positives)
    at = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id IS NOT NULL").where(usable)
    confirmed = cut_lineage(at.join(F.broadcast(sample), "id").select("text"), "toxic-positives")  # at most ``positives`` ids
    n_p = confirmed.count()
    if not n_p:
        return None
    held = (confirmed.mapInArrow(_count_all, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= MIN_TEXTS).orderBy("feature").collect())  # features of at least MIN_TEXTS of the sampled positives
    names, in_p = np.array([r["feature"] for r in held], np.int64), np.array([r["n"] for r in held], float)
    unlabelled = at.select("text")
    shared = docs.sparkSession.sparkContext.broadcast(names)
    counted = unlabelled.mapInArrow(_count_known(shared), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    by_name = {r["feature"]: r["n"] for r in counted}
    n_u = max(1, at.count())
    keep = chosen(in_p, n_p, np.array([by_name.get(h, 0) for h in names.tolist()], float), n_u) if len(names) else np.zeros(0, bool)
    names = names[keep]
    both = confirmed.select(F.lit(True).alias("positive"), "text").unionByName(unlabelled.select(F.lit(False).alias("positive"), "text"))
    table = both.mapInArrow(_sets(names), "positive boolean, features array<int>").groupBy("features").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("u"))
    table = cut_lineage(table, "toxic-sets")
    if table.agg(F.sum(F.size("features")).alias("n")).first()["n"] > entries:
        gradient = _spark_gradient(table, n_p, n_u, len(names))
    else:
        rows = table.orderBy("features").toArrow().combine_chunks()  # at most ``entries`` feature numbers
        of_p, of_u = (rows.column(c).to_numpy() / n for c, n in (("p", n_p), ("u", n_u)))
        gradient = Sets(rows.column("features").combine_chunks(), of_p, of_u, len(names)).gradient
    w, b = fit(gradient, len(names), prior)
    return names, w, b


def _score(model):
    def run(batches):
        weight = dict(zip(model[0].tolist(), model[1].tolist(), strict=True)) if model else {}
        held = _held(set(weight))
        for batch in text_slices(batches, 2048):
            out = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column("text").to_pylist()):
                out[k] = sum(weight[h] for h in held(text)) if weight else 0.0
            score = 1 / (1 + np.exp(-np.clip(out + model[2], -30, 30))) if model else out
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1)."""
    at = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return at.mapInArrow(_score(model), f"doc_id {at.schema['doc_id'].dataType.simpleString()}, score double")
