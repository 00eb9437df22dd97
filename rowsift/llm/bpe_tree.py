"""BPE encoding and decoding with tree concatenation for long unsplit text.

A run is a stretch of text between ASCII white space. No token of the tokenizer crosses white
space, so runs are encoded one by one (a bounded cache per worker keeps the runs seen before).
A run of more than ``LONG_RUN`` bytes is unsplit text: it is taken apart at special tokens, then
by the tokenizer's own normaliser and pre-tokenizer, and a pre-token of more than ``LEAF``
symbols is encoded as a tree: halves (leaf rows, spread over the cluster) are encoded in
parallel; at each join a growing window around the cut is encoded again until it shares a token
(same place, same id) with the left and with the right encoding, and the three are spliced.

Why agreement is enough: a token sequence is the BPE encoding of its text if and only if each
pair of neighbours is the encoding of the pair's text. Each neighbouring pair of the splice lies
within one of three encodings, and the tokens at cut ends (whose word-end mark is false) are
never taken as shared.

Scale: ordinary texts are a narrow map. Only distinct texts with long runs are shuffled, cut to
leaf rows; what one task then joins is one text. The tokenizer's JSON (a file of fixed size) is
shipped with the function, so executors need no local copy.

Defined results: a null text is the empty text (no tokens); null ids and repeated rows stay; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import LOWER_BYTES, text_slices

LONG_RUN = 2048
LEAF = 1024
WINDOW = 32
CACHE = 400_000
#: Marks that compose with ASCII letters (UTF-8), and the start of a special token: such texts are taken as they are.
AS_IT_IS = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]|<\|")
#: Closing punctuation after an ASCII letter or digit is a pre-token of its own: as a run of its own it is learned once.
CLOSING = re.compile(rb"(?<=[a-z0-9])([.,!?;:|]+)(?=[ \t\n\r\x0b\x0c]|$)")
SIMPLE = re.compile(rb"[a-z]+")

_LOADED: dict[int, "Encoder"] = {}


class Encoder:
    """A tokenizer with a bounded cache of runs: run -> (ids as little-endian bytes, decoded text)."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = [self.tok.id_to_token(k) for k in range(self.tok.get_vocab_size())]
        self.cache: dict[bytes, tuple[bytes, str]] = {}

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)

    def _learn(self, runs: list[bytes]) -> None:
        if len(self.cache) + len(runs) > CACHE:
            self.cache.clear()
        other = []
        for run in runs:
            if SIMPLE.fullmatch(run) and len(run) <= LONG_RUN:  # one pre-token that the normaliser leaves alone
                self._keep(run, [t.id for t in self.tok.model.tokenize(run.decode())])
            else:
                other.append(run)
        for run, e in zip(other, self.tok.encode_batch_fast([r.decode() for r in other], add_special_tokens=False), strict=True):
            self._keep(run, e.ids)

    def _keep(self, run: bytes, ids: list[int]) -> None:
        self.cache[run] = np.array(ids, "<u4").tobytes(), " ".join([self.names[k] for k in ids])

    def runs(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a text whose runs are short or may be encoded whole."""
        raw = text.encode()
        runs = raw.split() if AS_IT_IS.search(raw) else CLOSING.sub(rb" \1", raw.translate(LOWER_BYTES)).split()
        cache = self.cache
        if missing := [r for r in dict.fromkeys(runs) if r not in cache]:
            if len(missing) > CACHE // 2:  # one very long text: in parts
                parts = [self.runs(b" ".join(runs[k:k + CACHE // 4]).decode()) for k in range(0, len(runs), CACHE // 4)]
                return b"".join(p[0] for p in parts), " ".join(p[1] for p in parts if p[0])
            size = len(cache)
            self._learn(missing)
            if len(cache) < size + len(missing):  # it was cleared
                self._learn([r for r in dict.fromkeys(runs) if r not in cache])
        got = [cache[r] for r in runs]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])

    def words(self, run: str) -> list[tuple[str, str]]:
        """A run as (kind, text) in order: special tokens, and pre-tokens as symbol strings."""
        out = []
        for k, piece in enumerate(self.split.split(run) if self.split else [run]):
            if k % 2:
                out.append(("special", piece))
            elif piece:
                plain = self.tok.normalizer.normalize_str(piece) if self.tok.normalizer else piece
                out += [("word", w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def model(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token lengths (in symbols) of a symbol string taken as one word."""
        tokens = self.tok.model.tokenize(word)
        ends = len("</w>")
        sizes = [len(t.value) for t in tokens]
        if tokens and tokens[-1].value.endswith("</w>"):
            sizes[-1] -= ends
        return np.array([t.id for t in tokens], "<u4"), np.array(sizes, np.int64)


def loaded(source: str) -> Encoder:
    if (key := hash(source)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(source)
    return _LOADED[key]


def join(encode, symbols: str, left: tuple, right: tuple, cut: int, start: int, end: int) -> tuple:
    """Encoding of ``symbols[start:end]`` from those of ``[start:cut]`` and ``[cut:end]``.

    An encoding is (ids, sizes); ``encode(text)`` gives it for a text taken as a whole word."""
    ends_l, ends_r = start + np.cumsum(left[1]), cut + np.cumsum(right[1])
    starts_l, starts_r = ends_l - left[1], ends_r - right[1]
    width = WINDOW
    while True:
        a = int(starts_l[max(0, np.searchsorted(starts_l, cut - width, "right") - 1)]) if cut - width > start else start
        b = int(ends_r[min(len(ends_r) - 1, np.searchsorted(ends_r, cut + width, "left"))]) if cut + width < end else end
        ids, sizes = encode(symbols[a:b])
        ends_w = a + np.cumsum(sizes)
        starts_w = ends_w - sizes
        take_l, from_w, upto_w, from_r = 0, 0, len(ids), len(right[0])
        ok = True
        if a > start:  # a token that both have, not the left's last one (its word end is false)
            at = {(int(s), int(e), int(t)): k for k, (s, e, t) in enumerate(zip(starts_l[:-1], ends_l[:-1], left[0][:-1], strict=True)) if s >= a}
            shared = [(k, at[x]) for k, x in enumerate(zip(map(int, starts_w), map(int, ends_w), map(int, ids), strict=True))
                      if x in at and not (b < end and k == len(ids) - 1)]
            ok = bool(shared)
            if ok:
                from_w, take_l = shared[0][0], shared[0][1]
        if ok and b < end:
            at = {(int(s), int(e), int(t)): k for k, (s, e, t) in enumerate(zip(starts_r, ends_r, right[0], strict=True)) if e <= b}
            shared = [(k, at[x]) for k, x in enumerate(zip(map(int, starts_w), map(int, ends_w), map(int, ids), strict=True))
                      if x in at and k < len(ids) - 1 and k >= from_w]
            ok = bool(shared)
            if ok:
                upto_w, from_r = shared[-1]
        if ok:
            return (np.concatenate([left[0][:take_l], ids[from_w:upto_w], right[0][from_r:]]),
                    np.concatenate([left[1][:take_l], sizes[from_w:upto_w], right[1][from_r:]]))
        width *= 2


def joined(encode, symbols: str, leaves: list[tuple], bounds: list[int]) -> tuple:
    """The encoding of a word from those of its leaves (``bounds``: their starts and the end), joined
    pair by pair, level by level."""
    parts = [(leaf, bounds[k], bounds[k + 1]) for k, leaf in enumerate(leaves)]
    while len(parts) > 1:
        parts = [(join(encode, symbols, x[0], y[0], y[1], x[1], y[2]), x[1], y[2]) if y else (x[0], x[1], x[2])
                 for x, y in ((parts[k], parts[k + 1] if k + 1 < len(parts) else None) for k in range(0, len(parts), 2))]
    return parts[0][0]


def tree_encode(encode, symbols: str, leaf: int = LEAF) -> tuple:
    """One word by the tree, in this process (leaves, then joins)."""
    bounds = [*range(0, len(symbols), leaf), len(symbols)]
    return joined(encode, symbols, [encode(symbols[a:b]) for a, b in zip(bounds, bounds[1:])], bounds)


ENCODED = "doc_id {id}, n_tokens long, ids binary, decoded string"


def _plain(source: str):
    def run(batches):
        enc = loaded(source)
        for batch in text_slices(batches, 2048):
            got = [enc.runs(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                                              pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                                             names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


LEAVES = "key string, seq long, part long, kind string, payload string"


def _cut(source: str):
    """Rows of a text in order (seq): plain stretches, special tokens, words, and leaves (part) of long words."""
    def run(batches):
        enc = loaded(source)
        for batch in text_slices(batches, 64):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seq, plain, size = 0, [], 0
                for r in [*text.encode().split(), None]:
                    if plain and (r is None or len(r) > LONG_RUN or size > 65_536):
                        rows.append((key, seq, 0, "plain", b" ".join(plain).decode()))
                        seq, plain, size = seq + 1, [], 0
                    if r is None:
                        break
                    if len(r) <= LONG_RUN:
                        plain.append(r)
                        size += len(r)
                        continue
                    for kind, w in enc.words(r.decode()):
                        parts = range(0, max(1, len(w)), LEAF) if kind == "word" else (0,)
                        rows += [(key, seq, p, kind, w[a:a + LEAF] if kind == "word" else w) for p, a in enumerate(parts)]
                        seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    names=["key", "seq", "part", "kind", "payload"])
    return run


def _leaves(source: str):
    def run(batches):
        enc = loaded(source)
        for batch in batches:
            ids, sizes = [], []
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == "plain":
                    a, b = enc.runs(text)[0], b""
                elif kind == "special":
                    a, b = np.array([enc.tok.token_to_id(text)], "<u4").tobytes(), b""
                else:
                    a, b = (x.tobytes() for x in enc.model(text))
                ids.append(a)
                sizes.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())],
                                             names=[*batch.schema.names, "ids", "sizes"])
    return run


def _joined(source: str):
    def run(pdf):
        import pandas as pd

        enc = loaded(source)
        out = []
        for _, word in pdf.sort_values(["seq", "part"]).groupby("seq", sort=True):
            if len(word) == 1:
                out.append(word.ids.iloc[0])
                continue
            bounds = [0, *np.cumsum([len(p) for p in word.payload]).tolist()]
            leaves = [(np.frombuffer(i, "<u4"), np.frombuffer(s, np.int64)) for i, s in zip(word.ids, word.sizes, strict=True)]
            out.append(joined(enc.model, "".join(word.payload), leaves, bounds)[0].astype("<u4").tobytes())
        ids = b"".join(out)
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "n_tokens": [len(ids) // 4], "ids": [ids],
                             "decoded": [enc.decode(np.frombuffer(ids, "<u4").tolist())]})
    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text of every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    at = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = at.schema["doc_id"].dataType.simpleString()
    long_run = F.col("text").rlike(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{%d}" % (LONG_RUN // 4 + 1))
    # a run of LONG_RUN bytes has at least LONG_RUN / 4 code points; shorter ones in these texts are plain there, too
    plain = at.where(~long_run).mapInArrow(_plain(source), ENCODED.format(id=kind))
    hard = at.where(long_run).withColumn("key", F.sha2("text", 256))
    leaves = hard.select("key", "text").dropDuplicates(["key"]).mapInArrow(_cut(source), LEAVES)
    done = (leaves.repartition("key", "seq", "part").mapInArrow(_leaves(source), LEAVES + ", ids binary, sizes binary")
            .groupBy("key").applyInPandas(_joined(source), "key string, n_tokens long, ids binary, decoded string"))
    texts = hard.select("doc_id", "key").join(done, "key", "left").select(
        "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("ids", F.lit(b"")).alias("ids"),
        F.coalesce("decoded", F.lit("")).alias("decoded"))
    return plain.unionByName(texts)
