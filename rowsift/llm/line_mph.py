"""Line dedup through sharded minimal perfect hashes.

1. Every distinct line key of every document is hashed (64 + 32 bits) and written once as a table
   of (document, hashes); a partial aggregate per hash gives the distinct line hashes with the
   smallest id and the number of documents.
2. The distinct hashes of each shard, also those of a single document, become one minimal perfect
   hash (levels of bit arrays) with three compact arrays: a 64-bit fingerprint, the number of
   documents, and the smallest id.
3. Documents send their line hashes to the shards and probe the arrays there; lines whose count is
   two or more and whose smallest id is another document's come back per document, and the text is
   rebuilt without them.

Scale: lines are never joined with lines. The number of shards follows the counted lines, so a
shard and the probes of a group are bounded (``GROUP`` rows); a shard with a hot line (which may
be in a third of all documents) is copied to as many salts as its counted probes need, and the
probes are dealt to the salts by document. Texts are hashed once and move once, when the hits are
joined back.

Keys are told apart by 96 hash bits. Defined results: a null or empty text is one empty line; a
null id holds no lines for the counts and keeps all its lines; rows with the same id are one
document; an empty table gives an empty result; of the other columns those named in ``carry`` are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import BLANKS, LOWER, LOWER_BYTES, UPPER, text_slices
from rowsift.session import cut_lineage

LEAST = 10
GROUP = 8192
GAMMA = 2.0


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser per level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Mph:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key alone at its place sets a bit;
    the others go on to the next level. A key's index is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.rank = np.cumsum(bits) - bits
        self.at = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "Mph":
        levels = []
        while len(keys):
            size = max(8, int(GAMMA * len(keys)))
            place = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has a bit (surely not a key)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            place = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[left[hit]] = self.rank[self.at[k] + place[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        bits = np.concatenate(self.levels) if self.levels else np.zeros(0, bool)
        return np.packbits(bits).tobytes(), np.array([len(x) for x in self.levels], np.int64).tobytes()

    @classmethod
    def load(cls, bits: bytes, sizes: bytes) -> "Mph":
        n = np.frombuffer(sizes, np.int64)
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n.sum())).astype(bool)
        return cls(np.split(flat, np.cumsum(n)[:-1]) if len(n) else [])


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """64 bits that don't follow from a key's place: the other half of a mix, and the second hash."""
    return (_mix(h1, 77) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | h2.astype(np.uint64)


def _key64(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h1.astype(np.int64).view(np.uint64) ^ (h2.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93 + 2 * seed))


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _shard_arrays(pdf):
    import pandas as pd

    h1, h2 = pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64)
    seed = next(s for s in range(1000) if len(np.unique(_key64(h1, h2, s))) == len(h1))  # no two keys fall together
    keys = _key64(h1, h2, seed)
    mph = Mph.build(keys)
    at = mph.index(keys)
    order = np.argsort(at)
    bits, sizes = mph.dump()
    n = pdf.docs.to_numpy(np.int64)
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "salts": [1 + int(pdf["n"].sum()) // GROUP], "seed": [seed], "bits": [bits], "sizes": [sizes],
                         "fingerprints": [_fingerprint(h1.view(np.uint64), h2)[order].tobytes()],
                         "counts": [np.minimum(n, 2**32 - 1).astype(np.uint32)[order].tobytes()],
                         "keepers": [pdf["keep"].to_numpy(np.int64)[order].tobytes()]})


def _probe(left, right):
    import pandas as pd

    if not len(left) or not len(right):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "h1": np.zeros(0, np.int64), "h2": np.zeros(0, np.int64)})
    shard = left.iloc[0]
    mph = Mph.load(shard.bits, shard.sizes)
    prints, counts, keepers = (np.frombuffer(shard.fingerprints, np.uint64), np.frombuffer(shard.counts, np.uint32),
                               np.frombuffer(shard.keepers, np.int64))
    h1, h2, doc = right.h1.to_numpy(np.int64), right.h2.to_numpy(np.int64), right.doc_id.to_numpy(np.int64)
    at = mph.index(_key64(h1, h2, int(shard.seed)))
    safe = np.maximum(at, 0)
    lose = (at >= 0) & (prints[safe] == _fingerprint(h1.view(np.uint64), h2)) & (counts[safe] >= 2) & (keepers[safe] != doc)
    return pd.DataFrame({"doc_id": doc[lose], "h1": h1[lose], "h2": h2[lose]})


def _rebuild(names: list[str]):
    import xxhash

    strip = BLANKS.encode()

    def key(line: bytes) -> tuple[int, int] | None:
        k = line.strip(strip).translate(LOWER_BYTES)
        if len(k) < LEAST:
            return None
        h = xxhash.xxh64_intdigest(k, 42)
        return (h - (1 << 64) if h >> 63 else h, zlib.crc32(k))

    def run(batches):
        for batch in text_slices(batches, 2048):
            texts, n_lines, n_dropped = [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                text = text or ""
                lines = text.split("\n")
                n_lines.append(len(lines))
                if hits:
                    lose = {(h["h1"], h["h2"]) for h in hits}
                    kept = [x for x in lines if key(x.encode()) not in lose]
                    n_dropped.append(len(lines) - len(kept))
                    text = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*names, "text", "n_lines", "n_dropped"])
    return run


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of (doc_id, h1, h2): the distinct line hashes of each document."""
    keys = F.filter(F.transform(F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1), line_key),
                    lambda k: F.length(k) >= LEAST)
    pairs = F.array_distinct(F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.crc32(k).alias("h2"))))
    lines = (docs.select(docs[id_col].cast("long").alias("doc_id"), pairs.alias("k")).where(F.col("doc_id").isNotNull())
             .select("doc_id", F.explode("k").alias("k")).select("doc_id", "k.h1", "k.h2"))
    return cut_lineage(lines, "lines")


def shard_index(lines: DataFrame) -> tuple[DataFrame, Column]:
    """(index, shard): the written arrays of every shard over all distinct hashes of ``lines``, and the shard of a hash."""
    n_lines = lines.count()  # from the footers of the written table
    shard = F.pmod(F.shiftright("h1", 7), F.lit(max(1, -(-n_lines // GROUP)))).cast("long").alias("shard")
    # rows with one id are one document, so a hash counts ids: the smallest and largest differ from two documents on
    distinct = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    distinct = distinct.withColumn("docs", F.when(F.col("keep") < F.col("last"), F.greatest("n", F.lit(2))).otherwise(1))
    arrays = distinct.select(shard, "h1", "h2", "keep", "n", "docs").groupBy("shard").applyInPandas(
        _shard_arrays, "shard long, salts int, seed int, bits binary, sizes binary, fingerprints binary, counts binary, keepers binary")
    return cut_lineage(arrays, "line-shards"), shard


def losing_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hits: the hashes of the lines that the document loses."""
    lines = line_hashes(docs, id_col, text_col)
    index, shard = shard_index(lines)
    salted = index.where("salts > 1").select("shard", "salts")
    probes = lines.withColumn("shard", shard).join(salted, "shard", "left") \
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hits = copies.groupBy("shard", "salt").cogroup(probes.drop("salts").groupBy("shard", "salt")).applyInPandas(
        _probe, "doc_id long, h1 long, h2 long")
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry (a struct of the named columns, if any), text without the losing lines, n_lines
    (before), n_dropped."""
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), *([F.struct(*[docs[c] for c in carry]).alias("carry")] if carry else []),
                     docs[text_col].alias("text"))
    names = [c for c in at.columns if c != "text"]
    schema = at.select(*names, F.col("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return at.join(losing_lines(docs, id_col, text_col), "doc_id", "left").mapInArrow(_rebuild(names), schema)
