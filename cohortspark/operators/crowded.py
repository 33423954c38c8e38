"""Means of entities with very many observation windows, without a row per pair of event and window.

All windows of a sweep step have the same length and whole seconds as ends. So events of an item within one second
are in the same windows, and it is enough to know how many windows each such second is in. An event at second ``t``
is in the windows whose index lies in a closed range of ``span`` seconds that starts at ``t`` plus the gap. Cut time
into slices of ``span`` seconds: the range covers the end of one slice, from some offset on, and the next slice up to
just before the same offset. Both parts follow from running counts of index rows inside a slice, so no slice needs
more rows in a task than it has seconds, times items, labels and steps of the sweep.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_windows(
    events: DataFrame,
    index: DataFrame,
    *,
    entity: str,
    item: str,
    value: str,
    time: str,
    index_time: str,
    label: str,
    pred_hours: Sequence[int],
    obs_hours: int,
) -> DataFrame:
    """Per entity, item, second and prediction gap: its readings in brief, and the number of windows per label.

    Columns: entity, item, ``_at`` (the second), ``pred_hours``, label, ``_windows``, ``_sum`` and ``_n`` of the
    readings. A label is any value that index rows of the entity have, NULL included; each
    is counted by itself. Seconds in no window are left out.
    """
    span = obs_hours * 3600 + 1
    readings = events.groupBy(entity, item, F.unix_timestamp(time).alias("_at")).agg(
        F.sum(value).alias("_sum"),
        F.count(value).alias("_n"),
    )
    gaps = F.explode(F.array(*[F.lit(hours) for hours in pred_hours])).alias("pred_hours")
    begin = F.col("_at") + F.col("pred_hours") * F.lit(3600)
    labels = index.select(entity, label).distinct()
    asked = (
        readings.join(labels, entity)
        .select("*", gaps)
        .withColumns({"_slice": F.floor(begin / span), "_offset": F.pmod(begin, F.lit(span))})
        .select(
            entity, label, item, "_at", "pred_hours", "_sum", "_n", "_offset",
            F.inline(
                F.array(
                    F.struct(F.col("_slice"), F.lit(True).alias("_to_end")),
                    F.struct((F.col("_slice") + 1).alias("_slice"), F.lit(False).alias("_to_end")),
                )
            ),
            F.lit(0).cast("bigint").alias("_index_rows"),
        )
    )
    at_index = F.unix_timestamp(index_time)
    counted = index.groupBy(
        entity, label, F.floor(at_index / span).alias("_slice"), F.pmod(at_index, F.lit(span)).alias("_offset")
    ).agg(F.count(F.lit(1)).alias("_index_rows"))

    # A question stands before the index rows at its own offset and so counts those at smaller offsets.
    both = asked.unionByName(counted, allowMissingColumns=True).withColumn("_is_index", F.col("_at").isNull())
    in_slice = Window.partitionBy(entity, label, "_slice")
    before = in_slice.orderBy("_offset", "_is_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    below = F.sum("_index_rows").over(before)
    inside = F.when(F.col("_to_end"), F.sum("_index_rows").over(in_slice) - below).otherwise(below)
    parts = both.select("*", inside.alias("_inside")).where(~F.col("_is_index"))
    known = ["_sum", "_n"]
    per_second = parts.groupBy(entity, label, item, "_at", "pred_hours").agg(
        F.sum("_inside").alias("_windows"), *[F.first(c).alias(c) for c in known]
    )
    return per_second.where("_windows > 0").select(entity, item, "_at", "pred_hours", *known, label, "_windows")


def _weighed(chosen: Column | None = None) -> Column:
    """Mean of the readings, each counted once for every window that it is in; of the chosen ones only."""
    total, number = F.col("_sum") * F.col("_windows"), F.col("_n") * F.col("_windows")
    if chosen is not None:
        total, number = F.when(chosen, total), F.when(chosen, number)
    return F.sum(total) / F.nullif(F.sum(number), F.lit(0))


def wide_means_counted(counted: DataFrame, keys: Sequence[str], items: Mapping[Any, str], *, item: str) -> DataFrame:
    """One row per key with a column of means per declared item, from :func:`count_windows`."""
    return counted.groupBy(*keys).agg(*[_weighed(F.col(item) == F.lit(code)).alias(name) for code, name in items.items()])


def means_counted(counted: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Mean value of each item per key in long form, from :func:`count_windows`."""
    return counted.groupBy(*keys, item).agg(_weighed().alias(value))
