"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents come longest first. The open bins are kept in order of what is left in them; a bin
carries two bitmaps: the duplicate clusters of its documents, and how often each source is in it
(``SOURCE_SLOTS`` bits per source). The search starts at the first bin whose rest holds the
document and goes on to the next larger rest until a bin without a conflict is found: the
tightest compatible one. A bin never holds two documents of one cluster, nor more than
``SOURCE_SLOTS`` documents of one source.

A document longer than a bin is cut: full pieces have bins of their own, the rest is packed like
a document. So every token has exactly one place.

Scale: documents are dealt to shards by the hash of their id, text and number among equal rows; the
number of shards follows the counted documents, so each holds about ``SHARD`` documents whatever the
skew, and a hot source, cluster or repeated row spreads over all of them. Only ids, lengths and two codes are shuffled, no texts. Bins
are closed at the shard's end; what that leaves empty is bounded by the shard's open bins.

Defined results: a null or empty text has length 0 and lies in no bin (``bin_id`` null, size 0); a null source
is a source of its own; documents without a cluster (null) conflict with none; repeated rows are
documents of their own; a null id is dealt like 0; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsift.llm.common import BLANK_RUN, BLANKS
from rowsift.session import cut_lineage

CAPACITY = 2048
SOURCE_SLOTS = 4
SHARD = 4096


class Packer:
    """Open bins of one shard, in order of (rest, bin)."""

    def __init__(self, capacity: int = CAPACITY, slots: int = SOURCE_SLOTS):
        self.capacity, self.slots = capacity, slots
        self.rests: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []

    def fits(self, b: int, source: int, cluster: int) -> bool:
        """No bit of the cluster in the bin, and a free one among the source's."""
        field = ((1 << self.slots) - 1) << (source * self.slots)
        return not (cluster >= 0 and self.clusters[b] >> cluster & 1) and self.sources[b] & field != field

    def new(self) -> int:
        self.clusters.append(0)
        self.sources.append(0)
        return len(self.clusters) - 1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a document of ``size`` <= capacity."""
        at = bisect_left(self.rests, (size, -1))
        while at < len(self.rests) and not self.fits(self.rests[at][1], source, cluster):
            at += 1
        rest, b = self.rests.pop(at) if at < len(self.rests) else (self.capacity, self.new())
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        taken = self.sources[b] >> (source * self.slots) & ((1 << self.slots) - 1)
        self.sources[b] |= (taken + 1) << (source * self.slots)  # the lowest free bit: taken is a run of ones
        if rest > size:
            insort(self.rests, (rest - size, b))
        return b, self.capacity - rest


def _pack(capacity: int, slots: int):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        # a cluster with one document in the shard can't conflict: it needs no bit
        twice = pdf["cluster"].notna() & pdf.duplicated("cluster", keep=False)
        clusters = np.full(len(pdf), -1)
        clusters[twice.to_numpy()] = pd.factorize(pdf["cluster"][twice])[0]
        packer, rows = Packer(capacity, slots), []
        for k, size in enumerate(pdf["size"].tolist()):
            pieces = max(0, -(-size // capacity) - 1)
            for p in range(pieces):
                rows.append((k, p, packer.new(), 0, capacity))
            rows.append((k, pieces, *packer.put(size - pieces * capacity, int(sources[k]), int(clusters[k])), size - pieces * capacity))
        k, piece, b, offset, size = (np.array(c, np.int64) for c in zip(*rows))
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[k], "piece": piece, "shard": pdf["shard"].iloc[0], "bin": b, "bin_offset": offset, "size": size})
    return run


def n_words(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_RUN))).cast("long")


def cluster_of(text: Column) -> Column:
    """Code of the duplicate cluster: equal up to case and white space; null for a blank text."""
    t = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), BLANK_RUN, " ")
    return F.when(t != "", F.xxhash64(t))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None,
         cluster: Column | None = None, capacity: int = CAPACITY, slots: int = SOURCE_SLOTS) -> DataFrame:
    """doc_id, piece (from 0), bin_id, bin_offset, size: where each piece of each document lies. Sizes
    default to words, clusters to equal texts up to case and white space."""
    text = docs[text_col]
    at = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
                     (n_words(text) if size is None else size).cast("long").alias("size"),
                     (cluster_of(text) if cluster is None else cluster).alias("cluster"),
                     F.xxhash64(F.coalesce(docs[id_col].cast("long"), F.lit(0)), F.coalesce(text, F.lit(""))).alias("key"))
    rows = cut_lineage(at.groupBy(*at.columns).agg(F.count(F.lit(1)).alias("n")), "packing-rows")  # equal rows once, with their number
    shards = max(1, -(-(rows.where("size > 0").agg(F.sum("n")).first()[0] or 0) // SHARD))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SHARD).cast("long"))
    chunks = rows.where("n > 1").withColumn("from", F.explode(starts)).repartition("key", "from")
    repeated = chunks.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least("n", F.col("from") + SHARD) - 1))).drop("from", "n")
    every = rows.where("n = 1").drop("n").withColumn("copy", F.lit(0).cast("long")).unionByName(repeated)
    dealt = every.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).cast("long")).drop("copy")
    got = dealt.groupBy("shard").applyInPandas(_pack(capacity, slots), "doc_id long, piece long, shard long, bin long, bin_offset long, size long")
    got = got.select("doc_id", "piece", F.concat_ws("-", "shard", "bin").alias("bin_id"), "bin_offset", "size")
    zero = F.lit(0).cast("long")
    none = every.where("size <= 0").select("doc_id", zero.alias("piece"), F.lit(None).cast("string").alias("bin_id"), zero.alias("bin_offset"), zero.alias("size"))
    return got.unionByName(none)
