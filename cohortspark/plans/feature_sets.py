"""From index times and events to feature tables, for one observation window or a sweep of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.crowded import count_windows, wide_means_counted
from cohortspark.operators.features import (
    Rule,
    assemble_vectors,
    attach_static,
    dedupe_static,
    events_in_any_window,
    observation_window_join,
    unpivot_static,
    wide_items,
    wide_score,
)
from cohortspark.operators.joins import semi_join, spread_join
from cohortspark.sources.checkpoints import durable

# An entity with more index rows than this gets its windows counted when means are asked for.
MANY_WINDOWS = 100


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns and items make up a feature set.

    ``items`` maps the codes of measured items to column names, ``derived`` those of the score and the static
    attributes. ``static`` gives, by name, functions that return the expression of a static attribute of a stay; the
    first stay in ``stay_order`` counts.
    """

    entity: str
    item: str
    value: str
    time: str
    tie_break: str
    items: Mapping[Any, str]
    derived: Mapping[Any, str] = field(default_factory=dict)
    rules: Sequence[Rule] = ()
    static: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    stay_order: Sequence[str] = ()
    score: str = "score"
    index_time: str = "index_time"
    label: str = "label"

    def static_columns(self) -> dict[str, Column]:
        return {name: expression() for name, expression in self.static.items()}

    def feature_items(self) -> dict[Any, str]:
        """All items in ascending order of code: the layout of the vectors."""
        return dict(sorted({**self.derived, **self.items}.items()))


def feature_table(
    index: DataFrame,
    events: DataFrame,
    stays: DataFrame,
    spec: FeatureSpec,
    pred_hours: int | Sequence[int] = 8,
    obs_hours: int = 24,
    agg: str = "latest",
    salts: int | None = None,
    many_windows: int = MANY_WINDOWS,
) -> DataFrame:
    """One row per entity and label with its score, static attributes and items; NULL where an item is missing.

    Entities without an event in the window are absent. With a list of ``pred_hours`` there is a row for each of
    them, in a column ``pred_hours``, from one pass over the events.

    The events are reduced to wide rows in one aggregation and the score is an expression over these, so that
    after the join with the index only reduced rows are shuffled. For latest values the windows of an entity are merged
    before the join, however many there are. A mean counts an event once for each window; entities with more than
    ``many_windows`` index rows are not joined at all then: how many windows an event is in is counted instead, with the
    same result.
    """
    if agg not in ("latest", "mean"):
        raise ValueError(f"unknown aggregate {agg}")
    index = durable(index)
    swept = [] if isinstance(pred_hours, int) else ["pred_hours"]
    keys = [spec.entity, spec.label, *swept]
    wanted = events.where(F.col(spec.item).isin(*spec.items)).select(
        *dict.fromkeys([spec.entity, spec.item, spec.value, spec.time, spec.tie_break])
    )
    within = {"entity": spec.entity, "time": spec.time, "index_time": spec.index_time, "pred_hours": pred_hours, "obs_hours": obs_hours}
    if agg == "latest":
        windowed = events_in_any_window(wanted, index, label=spec.label, salts=salts, **within)
        any_crowded = False
    else:
        crowded = index.groupBy(spec.entity).count().where(F.col("count") > many_windows).select(spec.entity)
        any_crowded = not crowded.isEmpty()
        joinable = spread_join(index, crowded, spec.entity, "left_anti") if any_crowded else index
        windowed = observation_window_join(wanted, joinable, salts=salts, **within)
    wide = wide_items(
        windowed, keys, spec.items, item=spec.item, value=spec.value, time=spec.time, tie_break=spec.tie_break, agg=agg
    )
    if any_crowded:
        counted = count_windows(
            semi_join(wanted, crowded, spec.entity), semi_join(index, crowded, spec.entity), entity=spec.entity,
            item=spec.item, value=spec.value, time=spec.time, index_time=spec.index_time, label=spec.label,
            pred_hours=[pred_hours] if isinstance(pred_hours, int) else sorted(set(pred_hours)), obs_hours=obs_hours,
        )
        wide = wide.unionByName(wide_means_counted(counted, keys, spec.items, item=spec.item))
    scored = wide.withColumn(spec.score, wide_score(spec.rules, spec.items))
    if spec.static:
        static = dedupe_static(stays, spec.entity, spec.static_columns(), spec.stay_order)
        scored = attach_static(scored, static, spec.entity)
    return scored.select(*keys, *[name for name in spec.feature_items().values() if name in scored.columns])


def latest_features(
    index: DataFrame, events: DataFrame, stays: DataFrame, spec: FeatureSpec, pred_hours: int = 8, obs_hours: int = 24
) -> DataFrame:
    """Features from the latest value of each item in the window."""
    return feature_table(index, events, stays, spec, pred_hours, obs_hours, "latest")


def mean_features(
    index: DataFrame, events: DataFrame, stays: DataFrame, spec: FeatureSpec, pred_hours: int = 8, obs_hours: int = 24
) -> DataFrame:
    """Features from the mean value of each item in the window."""
    return feature_table(index, events, stays, spec, pred_hours, obs_hours, "mean")


def window_sweep(
    index: DataFrame,
    events: DataFrame,
    stays: DataFrame,
    spec: FeatureSpec,
    pred_hours: Sequence[int] = (1, 2, 4, 6, 8),
    obs_hours: int = 24,
    agg: str = "latest",
) -> DataFrame:
    """Feature tables for several prediction windows, told apart by ``pred_hours``."""
    return feature_table(index, events, stays, spec, list(pred_hours), obs_hours, agg)


def long_feature_table(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """A feature table as ``(keys..., item, value)`` rows, missing items without a row."""
    keys = [c for c in (spec.entity, spec.label, "pred_hours") if c in features.columns]
    codes = {name: code for code, name in spec.feature_items().items() if name in features.columns}
    return unpivot_static(features, keys, codes, spec.item, spec.value)


def feature_vectors(features: DataFrame, spec: FeatureSpec, fill: float = 0.0) -> DataFrame:
    """A feature table as ML vectors in ascending order of item, missing items as ``fill``."""
    keep = [c for c in (spec.entity, "pred_hours") if c in features.columns]
    columns = [name for name in spec.feature_items().values() if name in features.columns]
    return assemble_vectors(features, columns, label=spec.label, keep=keep, fill=fill)
