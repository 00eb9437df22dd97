"""Language ID with hyperdimensional profiles.

Each letter (and the gap between words) has a fixed random vector of +1 / -1. A trigram is the
product (binding) of its three letters' vectors, the first rolled twice and the second once
(permutation marks the place); a document is the sum (bundling) of its trigrams. A language's
prototype is the sum of the unit vectors of its training documents. A document gets the language
whose prototype has the highest cosine with it.

Documents and prototypes are compared after the mean of the prototypes' unit vectors (what all
languages share) is taken off; the reported cosine to the prototype itself stays the plain one.

Scale: both passes are narrow maps over Arrow slices of bounded size. Training sends one vector
per language and task to a partially aggregating sum; what comes to the driver and goes to the
tasks is one vector per language, whatever the number of documents or a source's share of them.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text
if there is no training row. Training rows with a null language, or without a letter, count
nothing. Null ids and repeated rows stay; an empty table gives an empty result; other columns of
the input are ignored.

A text that shares no trigram with the training texts has cosines around 0 with a standard deviation
of 1 / sqrt(dims) (``noise``), whatever its length; a text of a learned language rises out of that with the number
of its trigrams. ``decidable`` finds in the training texts from which number on it does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import text_slices

DIMS = 1024
UNKNOWN = "und"
BLOCK = 4096
GAP = 32
#: Cosines of unrelated texts stay below so many standard deviations.
SIGMAS = 4
#: A class of training texts by their number of trigrams tells learned from unrelated texts if it has
#: at least so many texts, and at most this share of them lies within the noise or so many standard deviations
#: above it (held-out texts lie a little lower than the training texts).
LEAST_TEXTS, SHARE, MARGIN = 20, 0.001, 2

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_vector(code: int, dims: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[code, dims])).integers(0, 2, dims).astype(np.float32) * 2 - 1


class Bundler:
    """Sums of bound trigram vectors of texts; keeps the vectors of letters seen (a few MB)."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.rolled = dims, {}

    def _letter(self, code: int) -> tuple[np.ndarray, ...]:
        if code not in self.rolled:
            if len(self.rolled) > 2000:
                self.rolled.clear()
            v = letter_vector(code, self.dims)
            self.rolled[code] = np.roll(v, 2), np.roll(v, 1), v
        return self.rolled[code]

    def _add(self, out: np.ndarray, n: np.ndarray, text: str, sizes: list[int]) -> None:
        """Adds the trigrams of texts (each with a gap on both sides, joined) to their rows, and their number to ``n``."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.where(_letters()[codes], codes, GAP)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP) | (doc[1:] != doc[:-1])
        codes, doc = codes[keep], doc[keep]
        alphabet, x = np.unique(codes, return_inverse=True)
        a = len(alphabet)
        whole = doc[2:] == doc[:-2]
        x = x.astype(np.int64)
        gram = ((x[:-2] * a + x[1:-1]) * a + x[2:])[whole]
        doc = doc[2:][whole]
        n += np.bincount(doc, minlength=len(n))
        if a**3 <= 4_000_000:
            seen = np.zeros(a**3, bool)
            seen[gram] = True
            grams = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            gram = place[gram]
        else:
            grams, gram = np.unique(gram, return_inverse=True)
        r2, r1, r0 = (np.stack(v) for v in zip(*(self._letter(int(c)) for c in alphabet)))
        for b in range(0, len(grams), BLOCK):
            g = grams[b:b + BLOCK]
            vectors = r2[g // (a * a)] * r1[g // a % a] * r0[g % a]
            if len(grams) > BLOCK:
                mine = (gram >= b) & (gram < b + BLOCK)
                counts = np.bincount(doc[mine] * len(g) + gram[mine] - b, minlength=len(out) * len(g))
            else:
                counts = np.bincount(doc * len(g) + gram, minlength=len(out) * len(g))
            out += counts.reshape(len(out), len(g)).astype(np.float32) @ vectors

    def bundle(self, texts: list[str | None], part: int = 400_000) -> np.ndarray:
        """One row per text; zero where it has no letter."""
        return self.counted(texts, part)[0]

    def counted(self, texts: list[str | None], part: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """``bundle`` and each text's effective number of trigrams: (sum of counts)² / (sum of squared counts),
        the latter from the vector's length. Repeats of one word add nothing to it."""
        out, n = np.zeros((len(texts), self.dims), np.float32), np.zeros(len(texts), np.int64)
        at, held, sizes = 0, [], []

        def flush(upto: int) -> None:
            if held:
                self._add(out[at:upto], n[at:upto], "".join(held), sizes)

        total = 0
        for k, text in enumerate(texts):
            low = f" {(text or '').lower()} "
            if len(low) > part:  # parts of a very long text, overlapping by two code points
                flush(k)
                for b in range(0, len(low) - 2, part):
                    piece = low[b:b + part + 2]
                    self._add(out[k:k + 1], n[k:k + 1], piece, [len(piece)])
                at, held, sizes, total = k + 1, [], [], 0
                continue
            held.append(low)
            sizes.append(len(low))
            total += len(low)
            if total > part:
                flush(k + 1)
                at, held, sizes, total = k + 1, [], [], 0
        flush(len(texts))
        squares = (out.astype(np.float64) ** 2).sum(axis=1) / self.dims
        return out, np.where(squares > 0, n.astype(np.float64) ** 2 / np.where(squares > 0, squares, 1), 0.0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _sums(dims: int):
    def run(batches):
        bundler, sums = Bundler(dims), {}
        for batch in text_slices(batches, 256, 1_000_000):
            vectors = unit(bundler.bundle(batch.column("text").to_pylist()).astype(np.float64))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                             names=["lang", "v"])
    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototype (summed unit vectors) per language, in the languages' order."""
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(_sums(dims), "lang string, v array<double>") \
        .groupBy("lang").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("lang", vector_to_array("s").alias("s"))
    found = {r["lang"]: np.array(r["s"]) for r in sums.collect()}  # one row per language
    return {k: found[k] for k in sorted(found) if np.any(found[k])}


def noise(dims: int = DIMS) -> float:
    """The cosine that unrelated texts stay below."""
    return SIGMAS / dims ** 0.5


def _classes(prototypes: dict[str, np.ndarray], dims: int):
    """Per class of texts (power of two below their number of trigrams): texts, and texts within the noise. The
    cosine is the one to the text's own language without the text itself."""
    def run(batches):
        bundler, n, low = Bundler(dims), np.zeros(64, np.int64), np.zeros(64, np.int64)
        for batch in text_slices(batches, 256, 1_000_000):
            vectors, grams = bundler.counted(batch.column("text").to_pylist())
            vectors = unit(vectors.astype(np.float64))
            some = vectors.any(axis=1)
            own = np.stack([prototypes.get(x, np.zeros(dims)) for x in batch.column("lang").to_pylist()]) - vectors
            inside = (vectors * unit(own)).sum(axis=1) <= noise(dims) + MARGIN / dims ** 0.5
            k = np.log2(np.maximum(grams, 1)).astype(int)
            n += np.bincount(k[some], minlength=64)
            low += np.bincount(k[some & inside], minlength=64)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.int64()), pa.array(low[k], pa.int64())], names=["k", "n", "low"])
    return run


def decidable(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang",
              dims: int = DIMS) -> float:
    """The effective number of trigrams from which on the training texts stand out of the noise in every class;
    infinity if they don't, or are too few to tell. A class above that is too small to tell follows the ones below it."""
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.mapInArrow(_classes(prototypes, dims), "k int, n long, low long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    least = float("inf")
    for r in sorted(found.collect(), reverse=True):  # at most 64 rows
        if r["n"] >= LEAST_TEXTS:
            if r["low"] > SHARE * r["n"]:
                break
            least = 2.0 ** r["k"]
    return least


def _predict(prototypes: dict[str, np.ndarray], dims: int):
    names = list(prototypes)

    def run(batches):
        bundler = Bundler(dims)
        plain = unit(np.stack(list(prototypes.values()))) if names else None
        common = plain.mean(axis=0) if len(names) > 1 else 0
        own = unit(plain - common) if names else None
        for batch in text_slices(batches, 256, 1_000_000):
            vectors, grams = bundler.counted(batch.column("text").to_pylist())
            vectors = unit(vectors.astype(np.float64))
            some = vectors.any(axis=1)
            if names:
                by_lang = unit(vectors - common) @ own.T
                best = by_lang.argmax(axis=1)
                langs = [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                cosine = np.where(some, np.take_along_axis(vectors @ plain.T, best[:, None], 1)[:, 0], 0.0)
                score = np.where(some, np.clip((1 + by_lang.max(axis=1)) / 2, 0, 1), 0.0)
            else:
                langs, cosine, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(score), pa.array(cosine), pa.array(grams)],
                                             names=[*keep, "lang_pred", "score", "cosine", "grams"])
    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            dims: int = DIMS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the compared cosine, halved and shifted), cosine (plain)."""
    at = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return at.mapInArrow(_predict(prototypes, dims), f"doc_id {at.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cosine double, grams double").drop("grams")


def annotate(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = DIMS,
             prefix: str = "_lid_") -> DataFrame:
    """``docs`` with all its columns and ``<prefix>lang``, ``<prefix>score``, ``<prefix>cosine``, ``<prefix>grams``."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    at = docs.select(*[docs[c].alias(n) for c, n in names.items()], docs[text_col].alias("text"))
    schema = at.select(*names.values(), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cosine"),
                       F.lit(0.0).alias("grams")).schema
    out = at.mapInArrow(_predict(prototypes, dims), schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("lang_pred").alias(prefix + "lang"),
                      F.col("score").alias(prefix + "score"), F.col("cosine").alias(prefix + "cosine"),
                      F.col("grams").alias(prefix + "grams"))
