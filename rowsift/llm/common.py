"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six white-space characters that separate words (``[\\x20\\x09-\\x0D]``).
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: the same as a Java / RE2 / Python character class, negated.
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing of A-Z for UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(batches: Iterator[pa.RecordBatch], rows: int, chars: int = 4_000_000,
                column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most ``rows`` rows and about ``chars`` bytes of text
    (one row at least), so that what a task holds in Python doesn't grow with the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        ends = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(ends.searchsorted(base + chars, "right"))))
            yield batch.slice(at, end - at)
            at = end


def held(df: DataFrame, id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(df[id_col].cast("string"), F.lit(""))) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
