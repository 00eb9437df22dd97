"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

1. Items are normalised (A-Z lower-cased, words of ASCII letters, digits and non-ASCII characters)
   and cut into windows of ``WINDOW`` consecutive words; an item of fewer words is one window.
2. The hashes of all windows become one sorted array with a bit filter in front, broadcast together
   with the normalised items.
3. Every document is scanned in vectors: word hashes from prefix sums of a polynomial over its
   bytes, window hashes from sums over word hashes, the filter, then the array. Each hit is verified
   word by word against the item, so that equal hashes of different windows never count.
4. ``remove`` takes the hit spans out of the texts or drops the documents.

Scale: one narrow pass over the documents, no shuffle; a document's work doesn't depend on how many
others hold the same passage. The broadcast is bounded: items are dealt to blocks of at most
``BLOCK_BYTES`` of normalised text (measured, not guessed; long items are cut into overlapping
pieces first), and with several blocks the documents pass them one after the other, written in
between, with the spans found so far. Long texts are hashed in bounded steps.

Defined results: null and empty texts have no words; a null document id stays null; a null item id
marks hits but isn't named in ``items``; rows of one item id are one item; repeated rows stay; empty
tables give no hits or no rows; other columns of the documents are kept by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import LOWER, UPPER, text_slices
from rowsift.session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 16 << 20
PIECE = 1000
STEP = 1 << 20
#: Fixed value: what a word consists of, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


class Words:
    """The words of a run of texts that lie one after the other in ``raw``; text k is
    ``raw[ends[k - 1]:ends[k]]``. Holds each word's place (``first``, ``last``: bytes, end exclusive) and hash,
    and per text the number of its first word (``at``, one entry more than texts)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.low = low = _LOWERED[raw]
        mask = np.concatenate([[False], _IS_WORD[low], [False]])
        begins = np.concatenate([[0], ends]).astype(np.int64)
        step = mask[1:] != mask[:-1]  # between byte k - 1 and byte k
        cut = begins[(begins > 0) & (begins < len(raw))]
        cut = np.unique(cut[mask[cut] & mask[cut + 1]])  # a word may end where the next text's first word starts
        edges = np.sort(np.concatenate([np.flatnonzero(step), cut, cut]))
        self.first, self.last = edges[0::2], edges[1::2]
        self.at = np.searchsorted(self.first, begins)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial of each word's bytes modulo 2**64, mixed; computed in steps of whole words."""
        out = np.empty(len(self.first), np.uint64)
        k = 0
        up = down = None
        with np.errstate(over="ignore"):
            while k < len(out):
                a = self.first[k]
                e = max(k + 1, int(np.searchsorted(self.last, a + STEP, "right")))
                n = int(self.last[e - 1] - a)
                if up is None or len(up) < n + 1:
                    up, down = _powers(_BASE, max(n, min(STEP, len(self.low)))), _powers(_BACK, max(n, min(STEP, len(self.low))))
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((self.low[a:a + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
                s, t = self.first[k:e] - a, self.last[k:e] - a
                out[k:e] = _mix((total[t] - total[s]) * down[s] ^ (t - s).astype(np.uint64))
                k = e
        return out

    def windows(self, sizes: list[int]):
        """(size, hashes) in rising size; entry i is the window of the words i to i + size - 1."""
        total = np.zeros(len(self.hash), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(max(sizes, default=0)):
                if k >= len(self.hash):
                    return
                total = total[:len(self.hash) - k] + self.hash[k:] * np.uint64(pow(_BASE, k + 1, 1 << 64))
                if k + 1 in sizes:
                    yield k + 1, _mix(total)

    def text(self, i: int, j: int) -> bytes:
        """The words i to j - 1, joined by blanks."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.first[i:j], self.last[i:j], strict=True))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a string column; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


class Index:
    """The windows of some normalised items: sorted hashes, where each window's words lie, and the items that hold it."""

    def __init__(self, items: list[tuple[str | None, str]]):
        raw = pa.array([t for _, t in items], pa.string())
        self.words = w = Words(*_texts(raw))
        self.names = [i for i, _ in items]
        n_words = np.diff(w.at)
        sizes = sorted({int(min(WINDOW, n)) for n in n_words if n})
        owner = np.repeat(np.arange(len(items)), n_words)
        parts = []
        for size, hashes in w.windows(sizes):
            at = np.arange(len(hashes))
            mine = owner[at]
            ok = (at + size <= w.at[mine + 1]) & (np.minimum(n_words[mine], WINDOW) == size)
            parts.append((hashes[ok], at[ok], np.full(int(ok.sum()), size), mine[ok]))
        self.hash, self.word, self.size, self.item = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(
            zip(*parts) if parts else [()] * 4, (np.uint64, np.int64, np.int64, np.int64)))
        order = np.lexsort((self.word, self.hash))
        self.hash, self.word, self.size, self.item = self.hash[order], self.word[order].astype(np.int32), self.size[order].astype(np.int8), self.item[order].astype(np.int32)
        self.sizes = sizes
        w.hash = np.zeros(0, np.uint64)  # not needed for lookups
        self.filter = np.zeros(1 << max(10, int(8 * len(self.hash)).bit_length()), bool)
        self.filter[self.hash & np.uint64(len(self.filter) - 1)] = True

    def lookup(self, h: np.uint64, size: int, text: bytes) -> frozenset | None:
        """Names of the items that hold exactly this window; None: no item holds it."""
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        same: dict[bytes, bool] = {}
        found, any_hit = set(), False
        for k in range(a, b):
            if self.size[k] != size:
                continue
            i = int(self.word[k])
            item_text = self.words.text(i, i + size)
            if item_text not in same:
                same[item_text] = item_text == text
            if same[item_text]:
                any_hit = True
                if (name := self.names[self.item[k]]) is not None:
                    found.add(name)
        return frozenset(found) if any_hit else None

    def scan(self, raw: np.ndarray, ends: np.ndarray):
        """(Words, hit per word, [(text number, item names)]) of some texts."""
        w = Words(raw, ends)
        hit = np.zeros(len(w.first) + 1, np.int64)
        owner = np.repeat(np.arange(len(ends)), np.diff(w.at))
        items: dict[int, set] = {}
        known: dict[tuple, frozenset | None] = {}
        if len(self.hash):
            for size, hashes in w.windows(self.sizes):
                at = np.flatnonzero(self.filter[hashes & np.uint64(len(self.filter) - 1)])
                at = at[at + size <= w.at[owner[at] + 1]]
                place = np.minimum(np.searchsorted(self.hash, hashes[at]), len(self.hash) - 1)
                at = at[self.hash[place] == hashes[at]]
                for i in at.tolist():
                    key = (size, w.text(i, i + size))
                    if key not in known:
                        known[key] = self.lookup(hashes[i], *key)
                    if (names := known[key]) is not None:
                        hit[i] += 1
                        hit[i + size] -= 1
                        items.setdefault(int(owner[i]), set()).update(names)
        return w, np.cumsum(hit)[:-1] > 0, items


def _spans(w: Words, hit: np.ndarray, k: int, raw: np.ndarray, begin: int, end: int) -> list[dict]:
    """Stretches of neighbouring hit words of text k, in code points of the text."""
    a, b = int(w.at[k]), int(w.at[k + 1])
    on = np.concatenate([[False], hit[a:b], [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    points = np.cumsum((raw[begin:end] & 0xC0) != 0x80)
    before = lambda byte: int(points[byte - begin - 1]) if byte > begin else 0
    return [{"start": before(int(w.first[a + s])), "end": before(int(w.last[a + e - 1])), "word": int(s), "word_end": int(e)}
            for s, e in zip(edge[0::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("word_end", pa.int64())]))
_SPANS_DDL = "array<struct<start:bigint,end:bigint,word:bigint,word_end:bigint>>"


def _merge(old: list[dict], new: list[dict]) -> list[dict]:
    """One list of stretches; those that overlap or touch in words become one."""
    out: list[dict] = []
    for s in sorted([*old, *new], key=lambda s: s["word"]):
        if out and s["word"] <= out[-1]["word_end"]:
            out[-1] = {**out[-1], "end": max(out[-1]["end"], s["end"]), "word_end": max(out[-1]["word_end"], s["word_end"])}
        else:
            out.append(s)
    return out


def _scan(shared):
    def run(batches):
        index: Index = shared.value
        for batch in text_slices(batches, 4096, column="_dc_text"):
            raw, ends = _texts(batch.column("_dc_text"))
            w, hit, items = index.scan(raw, ends)
            begins = np.concatenate([[0], ends[:-1]])
            spans, names = batch.column("_dc_spans").to_pylist(), batch.column("_dc_items").to_pylist()
            for k, found in items.items():
                spans[k] = _merge(spans[k], _spans(w, hit, k, raw, int(begins[k]), int(ends[k])))
                names[k] = sorted(found.union(names[k]))
            done = {"_dc_n_words": pa.array(np.diff(w.at), pa.int64()), "_dc_spans": pa.array(spans, _SPANS), "_dc_items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([done.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)
    return run


def normalised(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (id as string), words (joined by blanks): one row per distinct piece of an item. Pieces of long
    items overlap, so that each window lies whole in one of them."""
    words = F.regexp_extract_all(F.translate(F.coalesce(benchmark[text_col], F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    at = benchmark.select(benchmark[item_col].cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(PIECE))
    at = at.select("item", "w", F.explode(starts).alias("s"))
    return at.select("item", F.array_join(F.slice("w", F.col("s") + 1, F.lit(PIECE + WINDOW - 1)), " ").alias("words")).distinct()


def blocks(pieces: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(pieces with a column ``block``, number of blocks): no block holds more than ``limit`` bytes unless it is one piece."""
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    total = pieces.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // limit))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
        if n == 1 or not dealt.groupBy("block").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("k")).where(
                (F.col("b") > limit) & (F.col("k") > 1)).take(1):
            return dealt, n
        n *= 2


def _annotate(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, limit: int) -> DataFrame:
    """``docs`` with _dc_text, _dc_n_words, _dc_spans and _dc_items."""
    at = docs.withColumns({"_dc_text": F.coalesce(docs[text_col], F.lit("")), "_dc_n_words": F.lit(0).cast("long"),
                           "_dc_spans": F.array().cast(_SPANS_DDL), "_dc_items": F.array().cast("array<string>")})
    schema = at.schema
    pieces = cut_lineage(normalised(benchmark, item_col, item_text), "benchmark")
    dealt, n = blocks(pieces, limit)
    for b in range(n):
        rows = [(r["item"], r["words"]) for r in dealt.where(F.col("block") == b).collect()]  # at most ``limit`` bytes
        shared = docs.sparkSession.sparkContext.broadcast(Index(sorted(rows, key=lambda r: (r[1], r[0] or ""))))
        at = at.mapInArrow(_scan(shared), schema)
        if b < n - 1:
            at = cut_lineage(at, "decontaminate")
    return at


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start, end in code points; word, word_end: number of the words; ends
    exclusive; neighbouring hit words are one span) and items (ids of items with windows in the text, as sorted strings)."""
    at = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_dc_text_in"))
    found = _annotate(at, benchmark, "_dc_text_in", item_col, item_text, limit)
    return found.select("doc_id", F.col("_dc_n_words").alias("n_words"), F.col("_dc_spans").alias("spans"), F.col("_dc_items").alias("items"))


def n_hit(spans="spans"):
    """Number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word"])


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "spans", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without benchmark passages: ``how="spans"`` cuts the hit spans out of
    the texts (a blank stands for each), ``how="documents"`` drops documents with a hit."""
    if how not in ("spans", "documents"):
        raise ValueError("how is 'spans' or 'documents'")
    found = _annotate(docs, benchmark, text_col, item_col, item_text, limit)
    if how == "documents":
        return found.where(F.size("_dc_spans") == 0).select(*docs.columns)
    upto = lambda i: F.coalesce(F.get(F.col("_dc_spans"), i - 1)["end"], F.lit(0))
    piece = lambda s, i: F.substring(F.col("_dc_text"), (upto(i) + 1).cast("int"), (s["start"] - upto(i)).cast("int"))
    rest = F.substring(F.col("_dc_text"), (F.element_at("_dc_spans", -1)["end"] + 1).cast("int"), F.length("_dc_text"))
    cut = F.concat(F.array_join(F.transform("_dc_spans", lambda s, i: F.concat(piece(s, i), F.lit(" "))), ""), rest)
    return found.withColumn(text_col, F.when(F.size("_dc_spans") > 0, cut).otherwise(F.col(text_col))).select(*docs.columns)
