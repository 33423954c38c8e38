"""Matching texts against a table of LIKE patterns, without a test of every pattern on every text.

A text can only match a pattern if it holds the pattern's literal parts, and so each run of six characters in them. All
patterns' runs go to the Python workers, which look for them in one pass over the bytes of each text and compare the whole
literal part where one is found (``literal_runs``). Where a pattern is one literal between two ``%`` that settles it; other
patterns are tested as a whole on the texts that hold the part, those with an escape by Spark's LIKE. Patterns whose literals
are shorter are looked up by runs of three characters, two or one; patterns without any literal (``%``) are tested on all
texts. No text and no run is shuffled or stored.

The runs of at most ``MOST_RUNS`` are in memory at once. A larger table is taken in as many parts, one pass over the texts
for each, whose matches are put together by the MD5 of the lower-cased text: rows need no key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import column
from cohortspark.operators.joins import spread_join
from cohortspark.operators.literal_runs import Search, runs_of
from cohortspark.sources.checkpoints import durable

LENGTHS = (6, 3, 2, 1, 0)

#: Runs of patterns that are collected and sent to all workers at once; a run is some hundred bytes there.
MOST_RUNS = 1 << 19


def _grams(text: Column, length: int) -> Column:
    """All runs of so many characters, one from each place; the empty string stands for no character."""
    if length == 0:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _grams_of(length: int) -> Callable[[Column], Column]:
    return lambda text: _grams(text, length)


def pattern_grams(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, gram): the runs of characters that a text has to hold to match, all of the same, greatest length."""
    literals = F.regexp_extract_all("pattern", F.lit(r"([^%_\\]+)"), F.lit(1))
    listed = patterns.select(F.col(pattern).alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    listed = listed.withColumn("_literals", literals)
    grams = F.lit(None)
    for length in reversed(LENGTHS):  # the test for the longest comes out first
        found = F.flatten(F.transform("_literals", _grams_of(length))) if length else F.array(F.lit(""))
        grams = F.when(F.size(found) > 0, found).otherwise(grams)
    return listed.select("pattern", F.explode(F.array_distinct(grams)).alias("gram"))


def _searched(grams: DataFrame) -> Callable[[Column], Column]:
    """An expression for (found, likely): which of these patterns a text matches, and which with an escape it may match."""
    rows = grams.select(F.col("pattern").cast("binary"), F.col("gram").cast("binary"), F.char_length("gram").alias("n")).toArrow()
    runs = grams.sparkSession.sparkContext.broadcast(runs_of(rows))

    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(Search(runs.value), texts)

    kind = "found array<string>, likely array<string>"
    # said to be non-deterministic so that a filter on the result does not run it a second time
    return F.arrow_udf(search, kind).asNondeterministic()


def _tested(plain: Column, searched: Column) -> Column:
    """All patterns that match a text, in ascending order; those that are only likely are tested by LIKE."""
    likely = searched.getField("likely")
    # an array of one text, so that it is lower-cased once and not for each pattern
    tested = F.element_at(F.transform(F.array(plain), lambda text: F.filter(likely, lambda p: F.like(text, p))), 1)
    found = searched.getField("found")
    return F.when(F.size(likely) == 0, found).otherwise(F.sort_array(F.concat(found, tested)))


def matched_patterns(
    df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", output: str = "patterns", lower: bool = True
) -> DataFrame:
    """``df`` with an array of the patterns that match, in ascending order; NULL for a missing text.

    With ``lower`` the text is lower-cased first; patterns are taken as they are. Missing patterns match nothing.
    """
    plain = F.lower(column(text)) if lower else column(text).cast("string")
    grams = durable(pattern_grams(patterns, pattern))
    parts = -(-grams.count() // MOST_RUNS)
    if parts == 0:
        nothing = F.when(plain.isNotNull(), F.array().cast("array<string>"))
        return df.withColumn(output, nothing)
    if parts == 1:
        met = df.withColumn("_searched", _searched(grams)(plain))
        return met.withColumn(output, F.when(plain.isNotNull(), _tested(plain, F.col("_searched")))).select(*df.columns, output)
    texts = df.select(F.unhex(F.md5(plain)).alias("_digest"), plain.alias("text")).where(F.col("text").isNotNull())
    found = []
    for part in range(parts):
        some = grams.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        met = texts.withColumn("_searched", _searched(some)(F.col("text")))
        held = met.select("_digest", _tested(F.col("text"), F.col("_searched")).alias("_found")).where(F.size("_found") > 0)
        found.append(durable(held.groupBy("_digest").agg(F.first("_found").alias("_found"))))
    together = F.array_sort(F.flatten(F.collect_list("_found")))
    every = reduce(DataFrame.unionByName, found).groupBy("_digest").agg(together.alias("_found"))
    rows = df.withColumn("_digest", F.unhex(F.md5(plain)))
    met = spread_join(rows, durable(every), "_digest", "left", spread_by=[text])
    nothing = F.array().cast("array<string>")
    return met.withColumn(output, F.when(plain.isNotNull(), F.coalesce("_found", nothing))).select(*df.columns, output)


def match_any_of(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", lower: bool = True) -> DataFrame:
    """Rows whose text matches a pattern of the table; missing texts are dropped."""
    return matched_patterns(df, text, patterns, pattern, "_patterns", lower).where(F.size("_patterns") > 0).drop("_patterns")


def exclude_any_of(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", lower: bool = True) -> DataFrame:
    """Rows whose text matches no pattern of the table; missing texts are dropped, as NOT LIKE does."""
    return matched_patterns(df, text, patterns, pattern, "_patterns", lower).where(F.size("_patterns") == 0).drop("_patterns")
