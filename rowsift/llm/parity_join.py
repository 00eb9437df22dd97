"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct shingles. A wide parity sketch cuts the
hash range into segments and XORs the hashes of each; a token that two sets don't share changes
one segment, so the number of differing segments never exceeds the symmetric difference. Sets
with Jaccard similarity t differ in at most n (1 - t) / t tokens (n: either size). Within a band
of sizes all sets use the same segments; so of all but that many non-empty segments one at
least is equal. Each set sends as many segments plus one (its rarest by a bounded count of shingles over
all documents, then by hash), and equal segments meet in buckets. Candidate pairs pass the
Hamming bound of dense parity sketches (two bits per token at least), then the exact Jaccard test on the whole sets.

A set with too few non-empty segments sends all of them, and meets others of its kind by single
shingles in a band of their own; so no pair is lost.

Large buckets (groups of near copies) never emit all their pairs: their members are compared with
one central member, linked sets are merged to components, and only then members outside the
bucket's main component are compared with the rest, some more in each round, until each bucket
is in one component or every pair across components has been compared. Components are the
result, so links inside a component need no proof; no link across components is lost.

Scale: equal sets collapse first (a group of copies is one set). Segment keys travel packed in
rows of bytes, and a key that many sets of one task share sends one pair of them to the bucket
and the others past it, so no bucket holds a whole hot group. Sets are rebuilt from the texts
of the candidates alone. Sets are told apart by 64-bit hashes of their shingles.

Defined results: a null text, or one without a word, is empty and linked with nothing; a text
with fewer words than a shingle has one shingle of all its words; a row with a null id stays, is
linked with nothing and has a null component; repeated rows stay; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowsift.llm.common import LOWER_BYTES, text_slices
from rowsift.llm.components import components
from rowsift.session import cut_lineage

SHINGLE = 5
SIMILARITY = (3, 4)  # 0.75 as a fraction
BAND = 4
SEGMENTS = 2.0  # per token that may differ
SLOTS = 1 << 18
HOT_SLOTS = 65_536
KEYS_PER_BUCKET = 400_000
LOCAL = 64
SMALL = 8
LEAST_BITS = 1024
CHUNK = 2048
CALL_ROWS = 1024
BROADCAST_IDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Shingle hashes of texts, with a bounded cache of word hashes."""

    def __init__(self, words: int = SHINGLE):
        self.words, self.cache = words, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode().translate(LOWER_BYTES).split()
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(self.cache) > 300_000:
            self.cache.clear()
        hashes = np.fromiter(map(self.cache.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(hashes))
        out = np.full(len(hashes) - k + 1, k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = (out ^ hashes[j:len(hashes) - k + 1 + j]) * ODD
                out ^= out >> np.uint64(29)
        return np.unique(out)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def dense_sketch(s: np.ndarray) -> bytes:
    """Parity of the tokens at each of a power of two of places, two per token at least: Hamming
    distance <= symmetric difference. A wider sketch folds to a narrower one by XOR of its halves."""
    size = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length())
    place = ((s * ODD >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=size) & 1).tobytes()


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sketches (bytes), at the width of the narrower."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def differ(n: int, t: tuple[int, int] = SIMILARITY) -> int:
    """How many tokens at most are in one only of a set of n and a set similar to it."""
    return n * (t[1] - t[0]) // t[0]


def bands(n: int, t: tuple[int, int] = SIMILARITY) -> list[int]:
    """The band of size n, and the next if a similar set may lie there."""
    b, top = 0, BAND
    while top <= n:
        b, top = b + 1, top * BAND
    return [b, b + 1] if t[1] * n >= t[0] * top else [b]


def keys_of(s: np.ndarray, hot: np.ndarray | None, t: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Segment keys that a set sends."""
    out, n = [], len(s)
    need = differ(n, t) + 1
    heat = hot[(s & np.uint64(SLOTS - 1)).astype(np.int64)] if hot is not None else np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for b in bands(n, t):
            m = np.uint64(max(2, int(SEGMENTS * (differ(BAND ** (b + 1), t) + 1))))
            segment = (s >> np.uint64(32)) * m >> np.uint64(32)
            start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            key = (np.bitwise_xor.reduceat(s, start) ^ (np.uint64(b + 1) * np.uint64(0xD6E8FEB86659FD93))) * ODD
            key ^= key >> np.uint64(31)
            out.append(key[np.lexsort((key, np.logical_and.reduceat(heat, start)))[:need]])
            if len(key) < need:  # meets its like by single shingles
                alone = (s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * ODD
                alone ^= alone >> np.uint64(31)
                out.append(alone[np.lexsort((alone, heat))[:need]])
    return np.unique(np.concatenate(out))


def _profile(words: int):
    """doc_id, n, sid, sketch of every text; then, per task, the slots that hold more shingles than chance gives."""
    def run(batches):
        shingler, slots = Shingler(words), np.zeros(SLOTS, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        names = ["doc_id", "n", "sid", "sketch", "narrow", "slot", "slot_n"]
        for batch in text_slices(batches, 4096):
            n, sid, sketch, narrow = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                sketch.append(dense_sketch(s) if len(s) else None)
                narrow.append(fold(sketch[-1]).tobytes() if len(s) else None)
                np.add.at(slots, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip((n, sid, sketch, narrow, none, none), kinds[1:], strict=True)]], names=names)
        mean = slots.mean()
        much = np.flatnonzero(slots > mean + 5 * np.sqrt(mean) + 5)
        if len(much):
            none = [None] * len(much)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, none, none, none, none, much.astype(np.int32), slots[much]), kinds, strict=True)], names=names)
    return run


def _send(words: int, buckets: int, hot: np.ndarray, t: tuple[int, int]):
    def pack(keys, sids):
        """Rows of one flush: per bucket the pairs (4 bytes of key, 8 of set); hot keys' other sets pass by.
        Two keys of a bucket that agree in these bytes only make more pairs to test."""
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        place = np.arange(len(keys)) - np.repeat(start, np.diff(np.r_[start, len(keys)]))
        many = np.repeat(np.diff(np.r_[start, len(keys)]) > LOCAL, np.diff(np.r_[start, len(keys)]))
        past = many & (place >= 2)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        rest = keys // np.uint64(buckets)
        for some, passing in ((~past, False), (past, True)):
            b, r, s = bucket[some], rest[some], sids[some]
            order = np.argsort(b, kind="stable")
            b, r, s = b[order], r[order], s[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
            for a, z in zip(cuts, [*cuts[1:], len(b)]):
                for c in range(a, z, 1 << 16):
                    e = min(z, c + (1 << 16))
                    yield (int(b[a]), int(s[c] % 1_000_003) if passing else -1, r[c:e].astype("<u4").tobytes(), s[c:e].tobytes())

    def run(batches):
        shingler, seen, keys, sids, held = Shingler(words), set(), [], [], 0

        def flush():
            rows = list(pack(np.concatenate(keys), np.concatenate(sids)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                              names=["bucket", "past", "keys", "sids"])

        for batch in text_slices(batches, 4096):
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                k = keys_of(s, hot, t)
                keys.append(k)
                sids.append(np.full(len(k), sid, np.int64))
                held += len(k)
                if held >= 2_000_000:
                    yield flush()
                    keys, sids, held = [], [], 0
        if held:
            yield flush()
    return run


def _meet(buckets: int):
    """The members of keys that two or more sets sent; what passed by is given through."""
    def run(key, pdf):
        import pandas as pd

        rest = np.concatenate([np.frombuffer(k, "<u4") for k in pdf["keys"]]).astype(np.uint64)
        sids = np.concatenate([np.frombuffer(s, np.int64) for s in pdf["sids"]])
        if key[1] < 0:
            order = np.lexsort((sids, rest))
            rest, sids = rest[order], sids[order]
            new = np.r_[True, (rest[1:] != rest[:-1]) | (sids[1:] != sids[:-1])]
            rest, sids = rest[new], sids[new]
            start = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
            n = np.diff(np.r_[start, len(rest)])
            multi = np.repeat(n > 1, n)
            rest, sids = rest[multi], sids[multi]
        with np.errstate(over="ignore"):
            whole = (rest * np.uint64(buckets) + np.uint64(key[0])).view(np.int64)
        return pd.DataFrame({"key": whole, "sid": sids})
    return run


def _sets(words: int):
    def run(batches):
        shingler = Shingler(words)
        for batch in text_slices(batches, 2048):
            got = [(sid, s.tobytes()) for sid, t in zip(batch.column("sid").to_pylist(), batch.column("text").to_pylist(), strict=True)
                   if len(s := shingler(t)) and set_id(s) == sid]  # another text may have the same document id
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())],
                                                 names=["sid", "tokens"])
    return run


def fold(sketch: bytes) -> np.ndarray:
    """A dense sketch at the least width."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, LEAST_BITS // 64), axis=0)


def _near(t: tuple[int, int]):
    """Pairs that sketches allow; wide: both have dense sketches wider than the least."""
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = [(t[1] + t[0]) * hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= (t[1] - t[0]) * k
                    for x, y, k in zip(batch.column("s_a"), batch.column("s_b"), (n + m).tolist(), strict=True)]
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(2 * np.minimum(n, m) > LEAST_BITS, pa.bool_())], names=["a", "b", "wide"])
            yield found.filter(pa.array(keep, pa.bool_()))
    return run


def _places(sketches) -> np.ndarray:
    """Folded sketches side by side: one row per 64 places, one column per set."""
    return np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1).T)


def _across(t: tuple[int, int]):
    """Pairs of a member and a hub of one key in different components that the folded sketches allow;
    wide as in ``_near``. A call holds the blocks of many keys."""
    def run(left, right):
        import pandas as pd

        p, q, wide = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        if len(left) and len(right):
            bits, n, comps, sids = _places(left["narrow"]), left["n"].to_numpy(), left["comp"].to_numpy(), left["sid"].to_numpy()
            h_bits, h_n, h_comps, h_sids = _places(right["h_narrow"]), right["h_n"].to_numpy(), right["h_comp"].to_numpy(), right["h_sid"].to_numpy()
            hubs = right.groupby(["h_key", "h_salt"]).indices
            for block, rows in left.groupby(["key", "salt"]).indices.items():
                heads = hubs.get(block, ())
                step = max(1, (1 << 16) // len(rows))
                for some in (heads[i:i + step] for i in range(0, len(heads), step)):
                    less, more = (f(n[rows], h_n[some, None]) for f in (np.minimum, np.maximum))
                    apart = np.bitwise_count(bits[:, None, rows] ^ h_bits[:, some, None]).sum(axis=0, dtype=np.uint16)
                    near = (comps[rows] != h_comps[some, None]) & (t[1] * less >= t[0] * more)
                    near &= (t[1] + t[0]) * apart.astype(np.int64) <= (t[1] - t[0]) * (less + more)
                    hub, row = np.nonzero(near)
                    p.append(sids[rows[row]])
                    q.append(h_sids[some[hub]])
                    wide.append(2 * less[hub, row] > LEAST_BITS)
        return pd.DataFrame({"p": np.concatenate(p), "q": np.concatenate(q), "wide": np.concatenate(wide)})
    return run


def _verify(t: tuple[int, int]):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                linked.append(t[1] * both >= t[0] * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("p", "q")]
    return pairs.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *rest).distinct()


class Join:
    """One run over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY):
        self.docs, self.words, self.t = docs, words, similarity

    def profile(self) -> None:
        """Writes size, set id and sketch of every text; counts hot slots; one row per distinct set."""
        found = cut_lineage(self.docs.mapInArrow(_profile(self.words), "doc_id long, n long, sid long, sketch binary, narrow binary, slot int, slot_n long"), "sets")
        self.rows = found.where("n IS NOT NULL").select("doc_id", "n", "sid")
        hot = np.zeros(SLOTS, bool)  # only the order in which segments are sent: any list gives the same result
        slots = found.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("slot_n").alias("n")).orderBy(F.col("n").desc(), "slot").limit(HOT_SLOTS)
        hot[[r["slot"] for r in slots.collect()]] = True
        self.hot = hot
        sketches = found.where("sid IS NOT NULL AND doc_id IS NOT NULL")
        self.classes = cut_lineage(sketches.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("sketch").alias("sketch"), F.min("narrow").alias("narrow")), "classes")
        self.total = self.classes.agg(F.sum("n")).first()[0] or 0

    def members(self) -> DataFrame:
        """(key, sid, k, w): sets that sent a key which k >= 2 sets sent. Of w keys with the same members one stays:
        the others would only bring the same pairs again (members are told apart by their number and 62 bits of hashes)."""
        buckets = max(1, -(-int(0.4 * self.total) // KEYS_PER_BUCKET))
        packed = self.docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_send(self.words, buckets, self.hot, self.t), "bucket long, past long, keys binary, sids binary")
        met = cut_lineage(packed.groupBy("bucket", "past").applyInPandas(_meet(buckets), "key long, sid long"), "met")
        mark = F.xxhash64("sid")
        keys = met.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))).alias("low"),
                                      F.sum(F.shiftrightunsigned(mark, 33)).alias("high"))
        keys = keys.groupBy("k", "low", "high").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w")).select("key", "k", "w")
        return cut_lineage(met.join(keys, "key"), "members")

    def sketched(self, pairs: DataFrame, sketch: str) -> DataFrame:
        """(a, b, wide): the pairs whose sizes and sketches allow a link."""
        num, den = self.t

        def side(p: str) -> DataFrame:
            return self.classes.select(F.col("sid").alias(p), F.col("n").alias(f"n_{p}"), F.col(sketch).alias(f"s_{p}"))

        both = pairs.join(side("a"), "a").join(side("b"), "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near(self.t), "a long, b long, wide boolean")

    def near(self, folded: DataFrame) -> DataFrame:
        """Of the pairs (a, b, wide) that folded sketches allow, those that the whole ones allow too."""
        folded = cut_lineage(folded, "folded")
        wide = self.sketched(folded.where("wide").select("a", "b"), "sketch")
        return cut_lineage(folded.where("NOT wide").unionByName(wide).select("a", "b"), "near")

    def fetch(self, pairs: DataFrame) -> DataFrame:
        """(sid, tokens) of the sets in ``pairs``, from the texts of their representatives."""
        sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = cut_lineage(sids.join(self.classes.select("sid", "rep"), "sid"), "wanted")
        docs = self.docs.select(F.col("doc_id").alias("rep"), "text")
        small = wanted.count() <= BROADCAST_IDS  # else the texts are shuffled by id
        got = docs.join(F.broadcast(wanted) if small else wanted, "rep").select("sid", "text").mapInArrow(_sets(self.words), "sid long, tokens binary")
        return cut_lineage(got, "tokens")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of written pairs, exactly."""
        sets = self.fetch(pairs)
        x = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
        tested = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(self.t), "a long, b long, linked boolean")
        return cut_lineage(tested, "tested")

    def links(self) -> DataFrame:
        """(node, comp) of all sets that are linked."""
        members = self.members()
        few, many = members.where(F.col("k") <= SMALL), members.where(F.col("k") > SMALL)
        pairs = few.select("key", F.col("sid").alias("p")).join(few.select("key", F.col("sid").alias("q")), "key").where("p < q").select("p", "q")
        central = members.groupBy("sid").agg(F.sum(F.col("k") * F.col("w")).alias("c"))
        hubs = many.join(central, "sid").groupBy("key").agg(F.max(F.struct("c", "sid")).alias("h")).select("key", F.col("h.sid").alias("q"))
        star = many.select("key", F.col("sid").alias("p")).join(hubs, "key").select("p", "q")
        tested = self.verify(self.near(self.sketched(_ordered(pairs.unionByName(star)), "narrow")))
        comps = cut_lineage(components(tested.where("linked")), "comps")
        left, width = cut_lineage(many.join(hubs, "key").where("sid <> q").select("key", "sid"), "left"), 8 * SMALL
        while True:
            at = left.join(comps, left["sid"] == comps["node"], "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp"))
            open_keys = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
            at = cut_lineage(at.join(open_keys, "key"), "open")
            if at.isEmpty():
                return comps
            sizes = at.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
            main = cut_lineage(sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("k"))
                               .select("key", F.col("m.comp").alias("main"), (1 + F.floor(F.col("k") / CHUNK)).cast("int").alias("salts")), "main")
            some = Window.partitionBy("key").orderBy(F.xxhash64("sid"), "sid")
            hubs = cut_lineage(at.join(main, "key").where("comp <> main").withColumn("r", F.row_number().over(some))
                               .where(F.col("r") <= width).select("key", "sid", "comp", "salts"), "hubs")
            side = self.classes.select("sid", "n", "narrow")
            calls = 1 + at.count() // CALL_ROWS
            left_side = at.join(main, "key").join(side, "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
            right_side = hubs.join(self.classes.select("sid", F.col("n").alias("h_n"), F.col("narrow").alias("h_narrow")), "sid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            call = F.pmod(F.xxhash64("key", "salt"), F.lit(calls)).alias("call")
            across = left_side.select(call, "key", "salt", "sid", "comp", "n", "narrow").groupBy("call") \
                .cogroup(right_side.select(call, F.col("key").alias("h_key"), F.col("salt").alias("h_salt"), F.col("sid").alias("h_sid"),
                                           F.col("comp").alias("h_comp"), "h_n", "h_narrow").groupBy("call")) \
                .applyInPandas(_across(self.t), "p long, q long, wide boolean")
            new = self.verify(self.near(_ordered(across).join(tested.select("a", "b"), ["a", "b"], "left_anti")))
            edges = new.where("linked").select("a", "b")
            if not edges.isEmpty():
                comps = cut_lineage(components(edges.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "comps")
            tested = cut_lineage(tested.unionByName(new), "tested")
            left = cut_lineage(at.join(hubs.select("key", "sid"), ["key", "sid"], "left_anti").select("key", "sid"), "left")
            width *= 8


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the documents reachable by links)."""
    run = Join(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), words, similarity)
    run.profile()
    comps = run.links()
    classes = run.classes.select("sid", "rep")
    linked = comps.join(classes, comps["node"] == classes["sid"]).select("sid", "comp", "rep")
    named = linked.join(linked.groupBy("comp").agg(F.min("rep").alias("c")), "comp").select("sid", "c")
    names = cut_lineage(classes.join(named, "sid", "left").select("sid", F.coalesce("c", "rep").alias("component")), "names")
    return run.rows.join(names, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
