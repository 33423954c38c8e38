"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line rules here: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: One word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_columns(docs: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, for names that may be there already in another case."""
    names = {name.lower() for name in columns}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names], *[c.alias(n) for n, c in columns.items()])


_MADE: dict = {}


def once(sent: Broadcast, make: Callable):
    """What is made of a broadcast value, once in each worker process as long as it works with that value."""
    value = sent.value
    if _MADE.get("of") is not value:
        _MADE.update(of=value, made=make(value))
    return _MADE["made"]


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Slices of a column of texts, of at most so many bytes unless a single text is larger."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
