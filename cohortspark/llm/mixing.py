"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words: its share by weight of all words, but at most so many times its own size;
what exceeds that is shared out again by weight until nothing does. The words of a source divided into its target give
the copies of each document, in general a whole number and a fraction. The fractions of two documents are paired:
words move from one to the other, in a random direction, until one fraction is 0 or 1. The directions are weighed so
that each document keeps its expected copies, and the words of the two together stay the same, so a source ends at most
one document off its target.

The pairing is a reduction tree. Documents of a source fall into classes of about equal size (powers of two) and within
these into buckets of bounded size; each bucket is folded to one fraction that is left, buckets of these are folded
again, until a class has one left. A few documents of each class are set aside before; at last a source's left-overs and
these documents are folded from the largest to the smallest, so that large left-overs are settled by smaller documents
and what is left in the end is small. A source or class of any size is thus spread over all tasks, and no fold sees
more than a bounded number of documents. Random numbers are hashes of ids and a seed, so reruns agree.

Built-in functions only. Rows of the same id, source and size are one unit with the same number of copies. Documents
without words take no part and are taken 0 times; a null source is a source of its own, behind all others; a null text
has no words; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import n_words, table
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5, 2, 1)

#: At most so many times its size is taken of a document or source.
MOST_COPIES = 3

#: Documents of a bucket on average, and documents of a class that are set aside for the last fold.
BUCKET, SET_ASIDE = 128, 256

#: Ranges in which sources are ordered.
RANGES = 64


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): sources by code point, null last, places from 0, without one task for all."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = durable(
        sums.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    )
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # at most RANGES rows
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    numbered = ranged.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(before), "range").select("source", "source_size", (F.col("place") + F.col("before")).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no source above ``most`` times its size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = durable(ranked_sources(sizes).select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * most
    per_weight = 0.0
    while True:  # each round caps at least one further source; what is read is one row
        full = F.col("weight") * per_weight > cap
        words, capped, open_weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        rest = float(words or 0) - float(capped or 0)
        following = rest / open_weight if open_weight else per_weight
        if following <= per_weight:
            break
        per_weight = following
    return sources.select(
        "source", "source_size", F.least(F.col("weight") * per_weight, cap.cast("double")).alias("target")
    )


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 52)) / float(1 << 52)


def pair(a: Column, b: Column, seed: int) -> Column:
    """Two units after words have moved until one fraction is 0 or 1: struct(settled, open).

    Moving ``up`` words takes them from b to a, moving ``down`` words from a to b.
    """
    up = F.least((1 - a.part) * a.words, b.part * b.words)
    down = F.least(a.part * a.words, (1 - b.part) * b.words)
    rises = uniform(a.unit, b.unit, seed) * (up + down) < down
    a_full = (1 - a.part) * a.words <= b.part * b.words
    a_empty = a.part * a.words <= (1 - b.part) * b.words

    def with_part(x: Column, part: Column) -> Column:
        return F.struct(x.unit.alias("unit"), x.words.alias("words"), part.cast("double").alias("part"))

    def outcome(settled: Column, open_: Column) -> Column:
        return F.struct(settled.alias("settled"), open_.alias("open"))

    one, none = F.lit(1.0), F.lit(0.0)
    within = lambda x: F.greatest(none, F.least(one, x))
    return F.when(
        rises & a_full, outcome(with_part(a, one), with_part(b, within(b.part - up / b.words)))
    ).when(
        rises, outcome(with_part(b, none), with_part(a, within(a.part + up / a.words)))
    ).when(
        a_empty, outcome(with_part(a, none), with_part(b, within(b.part + down / b.words)))
    ).otherwise(outcome(with_part(b, one), with_part(a, within(a.part - down / a.words))))


def fold(units: Column, seed: int) -> Column:
    """An array of units folded in order: struct(done: array of settled units, open: the one that is left)."""
    unit = "struct<unit:bigint,words:double,part:double>"
    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.element_at(units, 1).cast(unit).alias("open"))

    def step(state: Column, following: Column) -> Column:
        met = pair(state.open, following, seed)
        return F.struct(F.concat(state.done, F.array(met.settled)).alias("done"), met.open.alias("open"))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def rounded(units: DataFrame, seed: int = 0, bucket: int = BUCKET, set_aside: int = SET_ASIDE) -> DataFrame:
    """(unit, extra): 0 or 1 for each of (unit, source key, words, part), the words of a key near their expectation.

    ``words`` is above 0 and ``part`` in (0, 1); units are distinct.
    """
    classed = units.withColumn("class", F.floor(F.log2("words")).cast("int"))
    counts = durable(classed.groupBy("key", "class").agg(F.count("*").alias("n")))
    sized = classed.join(counts, ["key", "class"])
    late = uniform(F.col("unit"), seed, 1) * F.col("n") < set_aside
    spread = durable(sized.select("key", "class", "unit", "words", "part", "n", late.alias("late")))
    open_, largest = spread.where(~F.col("late")), spread.agg(F.max("n")).first()[0] or 0
    settled, level = [], 0
    while largest > 1:
        buckets = F.ceil(F.col("n") / bucket)
        number = F.pmod(F.xxhash64("unit", F.lit(seed), F.lit(level + 2)), buckets)
        grouped = open_.groupBy("key", "class", "n", number.alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("unit", "words", "part"))).alias("units")
        )
        folded = durable(grouped.select("key", "class", F.ceil(F.col("n") / bucket).alias("n"), fold(F.col("units"), seed).alias("fold")))
        settled.append(folded.select(F.explode("fold.done").alias("u")).select("u.unit", "u.part"))
        open_ = folded.select("key", "class", "fold.open.unit", "fold.open.words", "fold.open.part", "n")
        largest, level = math.ceil(largest / bucket), level + 1
    left = open_.select("key", "unit", "words", "part").unionByName(
        spread.where("late").select("key", "unit", "words", "part")
    )
    last = left.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("order"), "unit", "words", "part"))).alias("units")
    )
    units_of = F.transform("units", lambda u: F.struct(u.unit.alias("unit"), u.words.alias("words"), u.part.alias("part")))
    folded = last.select(fold(units_of, seed).alias("fold"))
    ends = F.concat("fold.done", F.array("fold.open"))
    ended = folded.select(F.explode(ends).alias("u")).select("u.unit", "u.part")
    whole = F.when(F.col("part") > uniform(F.col("unit"), seed, 0), 1).otherwise(0)
    for more in settled:
        ended = ended.unionByName(more)
    return ended.select("unit", whole.alias("extra"))


def rows_to_mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(unit, key, doc_id, source, size): a key for each source, a unit for rows of the same id, source and size."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    return named.select(unit_of("doc_id", "source", "size").alias("unit"), key_of("source").alias("key"), "doc_id", "source", "size")


def unit_of(doc_id: Column | str, source: Column | str, size: Column | str) -> Column:
    return F.xxhash64(F.isnull(doc_id), doc_id, F.isnull(source), source, size)


def key_of(source: Column | str) -> Column:
    return F.xxhash64(F.isnull(source), source)


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(key, source_size, target, rate) of each source, and (unit, extra) of each unit that gets a copy more than the rate's floor.

    Both are stored. ``rows`` comes from :func:`rows_to_mix`; it is read several times and should be stored too.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = durable(
        source_targets(rows, weights, most).select(key_of("source").alias("key"), "source_size", "target", rate.alias("rate"))
    )
    units = rows.where(F.col("size") > 0).groupBy("unit", "key").agg(F.sum("size").cast("double").alias("words"))
    parts = units.join(targets, "key").select("unit", "key", "words", (F.col("rate") - F.floor("rate")).alias("part"))
    extra = rounded(parts.where(F.col("part") > 0), seed).where(F.col("extra") > 0)
    return targets, durable(extra.groupBy("unit").agg(F.max("extra").alias("extra")))


def with_copies(rows: DataFrame, targets: DataFrame, extra: DataFrame) -> DataFrame:
    """``rows`` (unit, key, ...) with source_size, target and copies."""
    number = (F.floor("rate") + F.coalesce("extra", F.lit(0))).cast("int")
    met = rows.join(targets, "key").join(extra, "unit", "left")
    return met.withColumn("copies", number).drop("rate", "extra")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    targets, extra = copies(durable(rows_to_mix(docs)), seed=seed)
    unit = unit_of("doc_id", "source", n_words(F.col("text")))
    keyed = docs.select(unit.alias("unit"), key_of("source").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_copies(keyed, targets, extra).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = durable(rows_to_mix(table(spark, folder, "documents")))
    mixed = with_copies(rows, *copies(rows))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
