"""Index times: when did the first of two kinds of event happen that follow one another closely enough?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import within_hours
from cohortspark.operators.joins import spread_join


def first_event_time(events: DataFrame, entity: str, time: str, alias: str | None = None) -> DataFrame:
    """Earliest time per entity; each map task sends at most one row per entity."""
    return (
        events.where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.min(time).alias(alias or time))
    )


def pair_first_events(
    a_events: DataFrame, b_events: DataFrame, entity: str, a_time: str, b_time: str
) -> DataFrame:
    """``(entity, first_a, first_b)`` for entities that have both kinds of event.

    Both tables are stacked and reduced in one aggregation, so there is one shuffle of partial minima and no join.
    """
    nothing = F.lit(None).cast("timestamp")
    a = a_events.select(entity, F.col(a_time).cast("timestamp").alias("first_a"), nothing.alias("first_b"))
    b = b_events.select(entity, nothing.alias("first_a"), F.col(b_time).cast("timestamp").alias("first_b"))
    return (
        a.unionByName(b)
        .where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.min("first_a").alias("first_a"), F.min("first_b").alias("first_b"))
        .where(F.col("first_a").isNotNull() & F.col("first_b").isNotNull())
    )


def first_kind(first_a: str = "first_a", first_b: str = "first_b") -> Column:
    """``B`` when b strictly precedes a, else ``A`` (also when both happen at once)."""
    return F.when(F.col(first_b) < F.col(first_a), F.lit("B")).otherwise(F.lit("A"))


def index_times(pairs: DataFrame, limit_b_then_a: float = 24.0, limit_a_then_b: float = 72.0) -> DataFrame:
    """Keep entities whose first two events are close enough, with the earlier one as ``index_time``.

    Some event of the later kind lies within the limit exactly when the first one does, so the two minima are
    all that is needed.
    """
    b_first = F.col("first_b") < F.col("first_a")
    kept = F.when(b_first, within_hours("first_a", "first_b", limit_b_then_a)).otherwise(
        within_hours("first_b", "first_a", limit_a_then_b)
    )
    return pairs.where(kept).withColumn("index_time", F.least("first_a", "first_b"))


def index_or_fallback(
    stays: DataFrame, indexed: DataFrame, entity: str, fallback_time: str, index_time: str = "index_time",
    label: str = "label", salts: int | None = None,
) -> DataFrame:
    """Index time of the entity, or the fallback time of each of its stays; the label tells which.

    An entity with an index time gives one row. One without gives a row for each different fallback time.
    """
    outs = stays.where(F.col(entity).isNotNull()).select(entity, F.col(fallback_time).alias("_fallback"))
    found = indexed.select(entity, F.col(index_time).alias("_index"))
    return (
        spread_join(outs, found, entity, "left", salts, ["_fallback"])
        .select(
            entity,
            F.coalesce(F.col("_index"), F.col("_fallback").cast("timestamp")).alias(index_time),
            F.col("_index").isNotNull().cast("int").alias(label),
        )
        .distinct()
    )


def index_dates(
    stays: DataFrame,
    a_events: DataFrame,
    b_events: DataFrame,
    *,
    entity: str,
    out_time: str,
    a_time: str,
    b_time: str,
    limit_b_then_a: float = 24.0,
    limit_a_then_b: float = 72.0,
    index_time: str = "index_time",
    label: str = "label",
    salts: int | None = None,
) -> DataFrame:
    """``(entity, index_time, label)`` for all stays; label 1 marks entities with an index time of their own."""
    pairs = pair_first_events(a_events, b_events, entity, a_time, b_time)
    indexed = index_times(pairs, limit_b_then_a, limit_a_then_b).withColumnRenamed("index_time", index_time)
    return index_or_fallback(stays, indexed, entity, out_time, index_time, label, salts)


def label_counts(index: DataFrame, label: str = "label") -> DataFrame:
    """One row: how many index rows are controls, how many are cases, and how many there are."""
    return index.agg(
        F.count_if(F.col(label) == 0).alias("controls"),
        F.count_if(F.col(label) == 1).alias("cases"),
        F.count(F.lit(1)).alias("total"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count of each named table, as ``(table_name, n_rows)``."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
