"""Features from the events in an observation window.

Events are joined to index times, reduced to one value per item, scored by rules, completed by static attributes
and laid out long, wide or as ML vectors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import seconds_before
from cohortspark.functions.sortable import order_key, pair_key
from cohortspark.operators.joins import DEFAULT_SALTS, fits_in_broadcast, spread_join


@dataclass(frozen=True)
class Rule:
    """``points`` for an item whose value compares to ``threshold`` by ``op`` (``<``, ``<=``, ``>``, ``>=``)."""

    item: Any
    op: str
    threshold: float
    points: float = 1.0

    def matches(self, value: Column) -> Column:
        tests = {
            "<": value < self.threshold,
            "<=": value <= self.threshold,
            ">": value > self.threshold,
            ">=": value >= self.threshold,
        }
        # Spark orders NaN above every number; a comparison with NaN must not give points.
        return tests[self.op] & ~F.isnan(value)


# --- observation window ------------------------------------------------------------------------------------------


def observation_window_join(
    events: DataFrame,
    index: DataFrame,
    *,
    entity: str,
    time: str,
    index_time: str = "index_time",
    pred_hours: int | Sequence[int] = 8,
    obs_hours: int = 24,
    salts: int | None = None,
) -> DataFrame:
    """Events with the index rows (and their label) in whose observation window they fall.

    A list of ``pred_hours`` gives one row per window an event falls in, told apart by a column ``pred_hours``;
    the events are still read, shuffled and joined only once.

    The join is on entity and time slice: a slice is as long as the window, so an event is in one slice and an index
    row in two, and an event only meets the index rows of its entity that are near it. The events of one entity are
    spread over their slices and, when the index table is not small enough to be broadcast, over salts.
    """
    windows = [pred_hours] if isinstance(pred_hours, int) else sorted(set(pred_hours))
    nearest, farthest = windows[0] * 3600, (windows[-1] + obs_hours) * 3600
    if salts is None:
        salts = 1 if fits_in_broadcast(index) else DEFAULT_SALTS
    width = F.lit(max(farthest - nearest, 1))
    at = F.unix_timestamp(index_time)
    first, last = F.floor((at - farthest) / width), F.floor((at - nearest) / width)
    sliced = events.withColumn("_slice", F.floor(F.unix_timestamp(time) / width))
    reached = index.withColumn("_slice", F.explode(F.sequence(first, last)))
    joined = spread_join(sliced, reached, [entity, "_slice"], "inner", max(salts, 1), [time]).drop("_slice")

    lead = seconds_before(index_time, time)
    joined = joined.where(lead.between(nearest, farthest))
    if isinstance(pred_hours, int):
        return joined
    inside = F.filter(
        F.array(*[F.lit(w) for w in windows]), lambda w: lead.between(w * 3600, (w + obs_hours) * 3600)
    )
    return joined.withColumn("pred_hours", F.explode(inside))


def events_in_any_window(
    events: DataFrame,
    index: DataFrame,
    *,
    entity: str,
    time: str,
    index_time: str = "index_time",
    label: str = "label",
    pred_hours: int | Sequence[int] = 8,
    obs_hours: int = 24,
    salts: int | None = None,
) -> DataFrame:
    """Events with each label (and prediction gap) of their entity for which they fall into at least one window.

    An event comes once for a label and gap, however many windows of these it is in: enough for latest values, and for
    means that count an event once. Windows are merged before the join. All windows of a gap have the same length, so
    with time cut into slices of that length, those that end in the slice of an event reach back to it exactly if the last
    of them ends late enough, and those that end in the next slice if the first of them ends soon enough; further ones
    never do. So an entity's windows shrink to two times for each slice, label and gap, by aggregation alone, and the join
    on entity and slice meets one row for an event.
    """
    gaps = [pred_hours] if isinstance(pred_hours, int) else sorted(set(pred_hours))
    span = obs_hours * 3600 + 1  # whole seconds of a window, both ends included
    ends = index.select(entity, label, F.explode(F.array(*map(F.lit, gaps))).alias("pred_hours"), F.unix_timestamp(index_time).alias("_end"))
    ends = ends.withColumn("_end", F.col("_end") - F.col("pred_hours") * 3600)
    ends = ends.withColumn("_slice", F.floor(F.col("_end") / span))
    keys = [entity, label, "pred_hours", "_slice"]
    merged = ends.groupBy(*keys).agg(F.min("_end").alias("_first"), F.max("_end").alias("_last"))
    nothing = F.lit(None).cast("bigint")
    here = F.struct(F.col("_slice"), F.col("_last"), nothing.alias("_first"))
    before = F.struct((F.col("_slice") - 1).alias("_slice"), nothing.alias("_last"), F.col("_first"))
    merged = merged.select(*keys[:3], F.inline(F.array(here, before)))
    merged = merged.groupBy(*keys).agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    held = merged.groupBy(entity, "_slice").agg(F.collect_list(F.struct(label, "pred_hours", "_last", "_first")).alias("_windows"))
    if salts is None:
        salts = 1 if fits_in_broadcast(index) else DEFAULT_SALTS
    at = F.unix_timestamp(time)
    sliced = events.withColumn("_slice", F.floor(at / span))
    joined = spread_join(sliced, held, [entity, "_slice"], "inner", max(salts, 1), [time])
    reached = F.filter("_windows", lambda w: (w["_last"] >= at) | (w["_first"] < at + span))
    columns = [c for c in events.columns if c not in (label, "pred_hours")]
    found = joined.select(*columns, F.inline(reached)).drop("_last", "_first")
    return found.drop("pred_hours") if isinstance(pred_hours, int) else found


# --- one value per item ------------------------------------------------------------------------------------------


def latest_per_item(
    windowed: DataFrame, keys: Sequence[str], item: str, value: str, time: str, tie_break: str
) -> DataFrame:
    """Latest value of each item per key; among equal times the largest ``tie_break`` decides, a missing one last.

    ``max_by`` orders by one number, so it is reduced by hashing in the map tasks: a key with very many events sends few
    rows, and no task sorts its events.
    """
    ordered = windowed.withColumn("_order", pair_key(windowed, time, tie_break))
    return ordered.groupBy(*keys, item).agg(F.max_by(value, "_order").alias(value))


def latest_per_item_ranked(
    windowed: DataFrame, keys: Sequence[str], item: str, value: str, time: str, tie_break: str
) -> DataFrame:
    """The same by ``row_number``: it sorts all events of a key in one task, and serves as a cross-check."""
    order = Window.partitionBy(*keys, item).orderBy(F.col(time).desc(), F.col(tie_break).desc())
    return (
        windowed.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*keys, item, value)
    )


def mean_per_item(
    windowed: DataFrame, keys: Sequence[str], item: str, value: str, dedupe_on: Sequence[str] = ()
) -> DataFrame:
    """Mean value of each item per key.

    An event that falls in several windows of a key counts once for each; ``dedupe_on`` names the columns that
    identify an event when it should count once.
    """
    if dedupe_on:
        windowed = windowed.dropDuplicates([*keys, item, *dedupe_on])
    return windowed.groupBy(*keys, item).agg(F.avg(value).alias(value))


def wide_items(
    windowed: DataFrame,
    keys: Sequence[str],
    items: Mapping[Any, str],
    *,
    item: str,
    value: str,
    time: str,
    tie_break: str,
    agg: str = "latest",
) -> DataFrame:
    """One row per key with a column per declared item (``items`` maps item to column name), in one aggregation."""
    if agg not in ("latest", "mean"):
        raise ValueError(f"unknown aggregate {agg}")
    if agg == "latest":
        windowed = windowed.withColumn("_order", pair_key(windowed, time, tie_break))
    columns = []
    for code, name in items.items():
        is_item = F.col(item) == F.lit(code)
        if agg == "latest":
            columns.append(F.max_by(value, F.when(is_item, F.col("_order"))).alias(name))
        else:
            columns.append(F.avg(F.when(is_item, F.col(value))).alias(name))
    return windowed.where(F.col(item).isin(*items)).groupBy(*keys).agg(*columns)


# --- rule-based score --------------------------------------------------------------------------------------------


def risk_score(
    per_item: DataFrame, keys: Sequence[str], item: str, value: str, rules: Sequence[Rule], alias: str = "score"
) -> DataFrame:
    """Sum of the points of all rules per key, from long ``(keys, item, value)`` rows; a missing item gives 0."""
    points = F.lit(0.0)
    for rule in rules:
        points = points + F.when(
            (F.col(item) == F.lit(rule.item)) & rule.matches(F.col(value)), F.lit(rule.points)
        ).otherwise(F.lit(0.0))
    return per_item.groupBy(*keys).agg(F.sum(points).alias(alias))


def wide_score(rules: Sequence[Rule], items: Mapping[Any, str]) -> Column:
    """The same score as an expression over the columns of :func:`wide_items`."""
    points = F.lit(0.0)
    for rule in rules:
        hit = rule.matches(F.col(items[rule.item]))
        points = points + F.when(hit, F.lit(rule.points)).otherwise(F.lit(0.0))
    return points


# --- static attributes -------------------------------------------------------------------------------------------


def dedupe_static(
    stays: DataFrame, entity: str, attributes: Mapping[str, Column], order_by: Sequence[str]
) -> DataFrame:
    """One row of attributes per entity, taken from its first stay in the given order."""
    described = stays.where(F.col(entity).isNotNull()).select(
        entity, order_key(stays, list(order_by)).alias("_order"), *[c.alias(name) for name, c in attributes.items()]
    )
    return described.groupBy(entity).agg(*[F.min_by(name, "_order").alias(name) for name in attributes])


def attach_static(features: DataFrame, static: DataFrame, entity: str) -> DataFrame:
    """Add the attributes of the entity; both sides have few rows per entity, entities without a stay are dropped."""
    return features.join(static, entity, "inner")


def unpivot_static(df: DataFrame, keys: Sequence[str], items: Mapping[str, Any], item: str, value: str) -> DataFrame:
    """Columns to rows: ``items`` maps a column to the item code of its rows. NULLs give no row."""
    entries = [F.struct(F.lit(code).alias(item), F.col(name).cast("double").alias(value)) for name, code in items.items()]
    return df.select(*keys, F.inline(F.array(*entries))).where(F.col(value).isNotNull())


def long_features(*parts: DataFrame) -> DataFrame:
    """Stack long feature tables by column name, duplicates kept."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- layout ------------------------------------------------------------------------------------------------------


def feature_index(long: DataFrame, item: str) -> DataFrame:
    """Items in ascending order with positions from 0.

    The list is as long as a feature vector is wide, so numbering it in one task is in order.
    """
    return (
        long.select(item).distinct().withColumn("position", F.row_number().over(Window.orderBy(item)) - F.lit(1))
    )


def declared_items(long: DataFrame, item: str) -> list[Any]:
    """The items of a long table in ascending order, for a layout that follows the data.

    This brings one value per feature to the driver, which has to know the width of the vectors anyway.
    """
    return [row[0] for row in long.select(item).distinct().orderBy(item).collect()]


def pivot_items(
    long: DataFrame, keys: Sequence[str], items: Mapping[Any, str], item: str, value: str, fill: float | None = 0.0
) -> DataFrame:
    """Long rows with one value per item to one row per key; items without a row get ``fill``."""
    columns = [F.max(F.when(F.col(item) == F.lit(code), F.col(value))).alias(name) for code, name in items.items()]
    wide = long.groupBy(*keys).agg(*columns)
    return wide if fill is None else wide.na.fill(fill, list(items.values()))


def assemble_vectors(
    wide: DataFrame, columns: Sequence[str], *, label: str = "label", output: str = "features",
    keep: Sequence[str] = (), fill: float = 0.0,
) -> DataFrame:
    """``(keep..., label double, features vector)``; missing values become ``fill``."""
    filled = wide.na.fill(fill, list(columns))
    assembled = VectorAssembler(inputCols=list(columns), outputCol=output).transform(filled)
    return assembled.select(*keep, F.col(label).cast("double").alias("label"), output)
