import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortspark.operators.crowded import count_windows
from cohortspark.operators.features import (
    Rule,
    assemble_vectors,
    declared_items,
    dedupe_static,
    events_in_any_window,
    feature_index,
    latest_per_item,
    latest_per_item_ranked,
    mean_per_item,
    observation_window_join,
    pivot_items,
    risk_score,
    unpivot_static,
    wide_items,
    wide_score,
)
from cohortspark.plans.feature_sets import FeatureSpec, feature_table, feature_vectors, long_feature_table, window_sweep

T0 = datetime(2020, 1, 10)
H = timedelta(hours=1)
S = timedelta(seconds=1)
KEYS = ["e", "label"]
ITEMS = {"a": "item_a", "b": "item_b", "c": "item_c"}
RULES = (Rule("a", "<", 15.0), Rule("b", "<=", 100.0), Rule("c", ">=", 22.0))

SPEC = FeatureSpec(
    entity="e", item="item", value="value", time="t", tie_break="id", items=ITEMS,
    derived={"0score": "score", "1age": "age"}, rules=RULES, static={"age": lambda: F.col("age")},
    stay_order=("in_t", "stay"),
)


def events_of(spark, data):
    return spark.createDataFrame(data, "id long, e long, item string, t timestamp, value double")


def index_of(spark, data):
    return spark.createDataFrame(data, "e long, index_time timestamp, label int")


@pytest.fixture(scope="module")
def crowd(spark):
    """Random events; entity 0 has a third of them and several index rows with overlapping windows."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        entity = 0 if i % 3 == 0 else rng.randint(1, 80)
        t = T0 - H * rng.randint(0, 40) - S * rng.choice([0, 0, 1, 1799])
        data.append((i, entity, rng.choice("abcd"), t, float(rng.randint(0, 120))))
    index = [(0, T0 - H * k, 0) for k in range(0, 12, 3)]
    index += [(e, T0 - H * rng.randint(0, 6), e % 2) for e in range(1, 70)]
    return events_of(spark, data).repartition(6).cache(), index_of(spark, index).cache(), data, index


def in_window(index_t, t, pred, obs):
    lead = int(index_t.timestamp()) - int(t.timestamp())
    return pred * 3600 <= lead <= (pred + obs) * 3600


@pytest.mark.parametrize("salts", [0, 1, 5])
def test_window_join_equals_brute_force(crowd, rows, salts):
    events, index, data, index_data = crowd
    joined = observation_window_join(events, index, entity="e", time="t", pred_hours=2, obs_hours=10, salts=salts)
    expected = [
        (i, e, label) for i, e, _, t, _ in data for k, at, label in index_data if k == e and in_window(at, t, 2, 10)
    ]
    assert rows(joined, "id", "e", "label") == sorted(expected, key=repr)


@pytest.mark.parametrize("salts", [0, 3])
def test_sweep_equals_separate_windows(crowd, rows, salts):
    events, index, _, _ = crowd
    swept = observation_window_join(
        events, index, entity="e", time="t", pred_hours=[1, 2, 8], obs_hours=6, salts=salts
    )
    single = []
    for hours in (1, 2, 8):
        one = observation_window_join(events, index, entity="e", time="t", pred_hours=hours, obs_hours=6)
        single += [(*r, hours) for r in rows(one, "id", "e", "label", "index_time")]
    assert rows(swept, "id", "e", "label", "index_time", "pred_hours") == sorted(single, key=repr)


def test_window_edges_are_inclusive_whole_seconds(spark, rows):
    events = events_of(
        spark,
        [
            (1, 1, "a", T0 - 8 * H, 1.0),
            (2, 1, "a", T0 - 8 * H + S, 2.0),
            (3, 1, "a", T0 - 32 * H, 3.0),
            (4, 1, "a", T0 - 32 * H - S, 4.0),
            (5, 2, "a", T0, 5.0),
        ],
    )
    index = index_of(spark, [(1, T0, 1), (2, T0, 0)])
    for salts in (0, 4):
        joined = observation_window_join(events, index, entity="e", time="t", salts=salts)
        assert rows(joined, "id") == [(1,), (3,)]


@pytest.mark.parametrize("salts", [None, 1, 5])
@pytest.mark.parametrize("pred_hours, obs_hours", [(2, 10), (0, 0), ([0, 1, 7], 5), ([3], 40)])
def test_events_come_once_for_a_label_however_many_windows(spark, crowd, rows, salts, pred_hours, obs_hours):
    events, index, data, index_data = crowd
    more = [(1, T0 - S * (1800 * k), k % 3 or None) for k in range(60)]  # overlapping windows, with a missing label
    found = events_in_any_window(
        events, index.unionByName(index_of(spark, more)), entity="e", time="t", pred_hours=pred_hours, obs_hours=obs_hours, salts=salts
    )
    gaps = [pred_hours] if isinstance(pred_hours, int) else pred_hours
    want = {
        (i, label, gap) for i, e, _, t, _ in data for k, at, label in [*index_data, *more] for gap in gaps
        if k == e and in_window(at, t, gap, obs_hours)
    }
    swept = found if not isinstance(pred_hours, int) else found.withColumn("pred_hours", F.lit(pred_hours))
    assert rows(swept, "id", "label", "pred_hours") == sorted(want, key=repr)
    assert found.columns == ["id", "e", "item", "t", "value", "label", *([] if isinstance(pred_hours, int) else ["pred_hours"])]


def test_merged_windows_join_an_event_once(spark):
    """One entity with every event as an index row: as many rows leave the join as there are events."""
    events = spark.range(3000).select("id", F.lit(1).cast("long").alias("e"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    index = events.select("e", F.col("t").alias("index_time"), (F.col("id") % 2).alias("label"))
    found = events_in_any_window(events, index, entity="e", time="t", pred_hours=[1, 2], obs_hours=24)
    rows = found.count()
    assert rows == sum(min(2, max(0, 3000 - i - 60 * p)) for i in range(3000) for p in (1, 2))
    joined = observation_window_join(events, index, entity="e", time="t", pred_hours=[1, 2], obs_hours=24).count()
    assert joined > 500 * rows


def windowed(crowd):
    events, index, _, _ = crowd
    return observation_window_join(events, index, entity="e", time="t", pred_hours=2, obs_hours=20)


def test_latest_equals_row_number(crowd, rows):
    w = windowed(crowd)
    latest = latest_per_item(w, KEYS, "item", "value", "t", "id")
    assert rows(latest) == rows(latest_per_item_ranked(w, KEYS, "item", "value", "t", "id"))


def test_latest_tie_takes_larger_tie_break(spark, rows):
    w = spark.createDataFrame(
        [(1, 0, "a", T0, 5, 1.0), (1, 0, "a", T0, 9, 2.0), (1, 0, "a", T0 - S, 11, 3.0)],
        "e long, label int, item string, t timestamp, id long, value double",
    )
    assert rows(latest_per_item(w, KEYS, "item", "value", "t", "id")) == [(1, 0, "a", 2.0)]


def test_mean_counts_an_event_once_per_window(spark, rows):
    events = events_of(spark, [(1, 1, "a", T0 - 10 * H, 10.0), (2, 1, "a", T0 - 33 * H, 40.0)])
    index = index_of(spark, [(1, T0, 0), (1, T0 - 2 * H, 0)])
    w = observation_window_join(events, index, entity="e", time="t")
    assert rows(mean_per_item(w, KEYS, "item", "value")) == [(1, 0, "a", 20.0)]
    assert rows(mean_per_item(w, KEYS, "item", "value", dedupe_on=["id"])) == [(1, 0, "a", 25.0)]


@pytest.mark.parametrize("agg", ["latest", "mean"])
def test_wide_items_equal_pivoted_long_rows(crowd, rows, agg):
    w = windowed(crowd)
    if agg == "latest":
        long = latest_per_item(w, KEYS, "item", "value", "t", "id")
    else:
        long = mean_per_item(w, KEYS, "item", "value")
    wide = wide_items(w, KEYS, ITEMS, item="item", value="value", time="t", tie_break="id", agg=agg)
    pivoted = pivot_items(long.where("item <> 'd'"), KEYS, ITEMS, "item", "value", fill=None)
    names = [*KEYS, *[F.round(c, 9).alias(c) for c in ITEMS.values()]]
    assert rows(wide.select(*names)) == rows(pivoted.select(*names))
    score = risk_score(long, KEYS, "item", "value", RULES)
    wide_scores = wide.select(*KEYS, wide_score(RULES, ITEMS).alias("score"))
    only_d = score.join(wide_scores, KEYS, "left_anti")
    assert rows(wide_scores) == rows(score.join(wide_scores.select(*KEYS), KEYS, "left_semi"))
    assert all(r.score == 0.0 for r in only_d.collect())


def test_score_thresholds(spark, rows):
    nan = float("nan")
    long = spark.createDataFrame(
        [(1, "a", 14.9), (1, "b", 100.0), (1, "c", 22.0), (2, "a", 15.0), (2, "b", 100.1), (2, "c", 21.9),
         (3, "z", 0.0), (4, "c", nan), (4, "a", None)],
        "e long, item string, value double",
    )
    assert rows(risk_score(long, ["e"], "item", "value", RULES)) == [(1, 3.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_static_attributes_come_from_the_first_stay(spark, rows):
    stays = spark.createDataFrame(
        [(1, 2, T0 + H, 51.0), (1, 1, T0, 50.0), (1, 0, T0 + 2 * H, 52.0), (None, 9, T0, 1.0), (2, 4, T0, None)],
        "e long, stay long, in_t timestamp, age double",
    )
    static = dedupe_static(stays, "e", {"age": F.col("age")}, ["in_t", "stay"])
    assert rows(static) == [(1, 50.0), (2, None)]
    assert rows(unpivot_static(static, ["e"], {"age": 2}, "item", "value")) == [(1, 2, 50.0)]


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame(
        [(e, 1, T0, 40.0 + e) for e in range(0, 60)], "e long, stay long, in_t timestamp, age double"
    )


@pytest.mark.parametrize("agg", ["latest", "mean"])
def test_feature_table_layouts_agree(crowd, stays, rows, agg):
    events, index, _, _ = crowd
    table = feature_table(index, events, stays, SPEC, 2, 10, agg)
    assert table.columns == ["e", "label", "score", "age", "item_a", "item_b", "item_c"]
    entities = {r.e for r in table.collect()}
    assert entities and entities <= set(range(60))
    assert rows(table) == rows(feature_table(index, events, stays, SPEC, 2, 10, agg, salts=3))
    long = long_feature_table(table, SPEC)
    again = pivot_items(long, KEYS, SPEC.feature_items(), "item", "value")
    assert rows(again) == rows(table.na.fill(0.0))
    vectors = feature_vectors(table, SPEC)
    arrays = vectors.select("e", "label", vector_to_array("features").alias("v")).collect()
    plain = {r.e: [float(x) for x in r[2:]] for r in table.na.fill(0.0).collect()}
    assert {r.e: list(r.v) for r in arrays} == plain


@pytest.mark.parametrize("agg", ["latest", "mean"])
@pytest.mark.parametrize("pred_hours, obs_hours", [(2, 10), (0, 0), ([0, 1, 7], 5)])
@pytest.mark.parametrize("many_windows", [0, 3])
def test_counted_windows_equal_joined_ones(crowd, stays, rows, agg, pred_hours, obs_hours, many_windows):
    """All entities counted, and only the one with several index rows."""
    events, index, _, _ = crowd
    joined = feature_table(index, events, stays, SPEC, pred_hours, obs_hours, agg)
    counted = feature_table(index, events, stays, SPEC, pred_hours, obs_hours, agg, many_windows=many_windows)
    if agg == "mean":
        names = [F.round(c, 9).alias(c) if c.startswith("item") else F.col(c) for c in joined.columns]
        joined, counted = joined.select(*names), counted.select(*names)
    assert joined.columns == counted.columns
    assert rows(joined) == rows(counted)


@pytest.mark.parametrize("agg", ["latest", "mean"])
def test_a_limit_on_windows_changes_no_row(spark, stays, rows, agg):
    """Entities just below, at and above the limit, with labels 0, 1, 2 and NULL; sums of the values are exact."""
    rng = random.Random(8)
    events = events_of(spark, [(i, rng.randint(0, 5), rng.choice("abc"), T0 - S * rng.randint(0, 90000), rng.randint(0, 400) / 4) for i in range(900)])
    index = index_of(spark, [(e, T0 - S * (7 * k), rng.choice([0, 1, 2, None])) for e in range(6) for k in range(10 + e)])
    results = [rows(feature_table(index, events, stays, SPEC, 2, 10, agg, many_windows=n)) for n in (1000, 14, 12, 9, 0)]
    assert len(results[0]) == 24 and all(r == results[0] for r in results[1:])


def test_latest_values_are_reduced_by_hashing(crowd):
    events, index, _, _ = crowd
    windowed = observation_window_join(events, index, entity="e", time="t", pred_hours=2, obs_hours=10)
    stays = windowed.select("e", "t", "id", "value")
    made = [dedupe_static(stays, "e", {"v": F.col("value")}, ["t", "id"]), dedupe_static(stays, "e", {"v": F.col("value")}, ["t", "value"])]
    for tie in ("id", "value"):
        made.append(latest_per_item(windowed, KEYS, "item", "value", "t", tie))
        made.append(wide_items(windowed, KEYS, ITEMS, item="item", value="value", time="t", tie_break=tie))
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ties_between_numbers_that_are_hard_to_order(spark, rows):
    nan, inf = float("nan"), float("inf")
    cases = {"a": [None, -inf, -1.5], "b": [5e-324, 0.0, -0.0], "c": [1.0, nan, inf], "d": [None, None, None], "z": [-5e-324, -2.0, -0.0]}
    data = [(1, 0, k, T0 - S * late, v) for k, values in cases.items() for v in values for late in (0, 1)]
    w = spark.createDataFrame(data, "e long, label int, item string, t timestamp, value double").repartition(5)
    ranked = latest_per_item_ranked(w, KEYS, "item", "value", "t", "value")
    got = latest_per_item(w, KEYS, "item", "value", "t", "value")
    assert repr(rows(got)) == repr(rows(ranked))


def test_events_meet_only_near_windows(spark):
    """One entity with 2,000 windows and 2,000 events over 2,000 days: an event is joined to few of them."""
    day = 86400
    events = spark.range(2000).select("id", F.lit(1).cast("long").alias("e"), F.timestamp_seconds(F.col("id") * day).alias("t"))
    index = spark.range(2000).select(F.lit(1).cast("long").alias("e"), F.timestamp_seconds(F.col("id") * day + 40000).alias("index_time"))
    for salts in (None, 4):
        df = observation_window_join(events, index, entity="e", time="t", pred_hours=8, obs_hours=24, salts=salts)
        assert df.count() == 1999 + 1
        join = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert "_slice" in join[0]


def test_counting_emits_no_pairs(spark):
    """One entity with 2,000 windows and 2,000 events: the plan joins no event with an index row."""
    events = spark.range(2000).select(
        "id", F.lit(1).cast("long").alias("e"), F.lit("a").alias("item"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") % 700).alias("t"), (F.col("id") % 10).cast("double").alias("value"),
    )
    index = spark.range(2000).select(
        F.lit(1).cast("long").alias("e"), F.timestamp_seconds(F.lit(1_600_003_600) + F.col("id") % 900).alias("index_time"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    counted = count_windows(
        events, index, entity="e", item="item", value="value", time="t", index_time="index_time",
        label="label", pred_hours=[1], obs_hours=1,
    )
    joins = [x for x in counted._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1 and "index_time" not in joins[0]  # seconds meet the two labels of the entity only
    index_seconds = [(1_600_003_600 + i % 900, i % 2) for i in range(2000)]
    expected = {}
    for second in range(1_600_000_000, 1_600_000_700):
        for label in (0, 1):
            inside = sum(1 for s, y in index_seconds if y == label and 3600 <= s - second <= 7200)
            if inside:
                expected[second, label] = inside
    got = counted.collect()
    assert {(r._at, r.label): r._windows for r in got} == expected
    assert sum(r._n for r in got if r.label == 0) == sum(
        1 for i in range(2000) if (1_600_000_000 + i % 700, 0) in expected
    )


def test_sweep_of_feature_tables(crowd, stays, rows):
    events, index, _, _ = crowd
    swept = window_sweep(index, events, stays, SPEC, (2, 4), 10)
    for hours in (2, 4):
        one = feature_table(index, events, stays, SPEC, hours, 10)
        assert rows(swept.where(F.col("pred_hours") == hours).drop("pred_hours")) == rows(one)


def test_results_do_not_depend_on_partitions(spark, crowd, stays, rows):
    events, index, _, _ = crowd
    expected = rows(feature_table(index, events, stays, SPEC, 2, 10))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(feature_table(index, events.coalesce(1), stays, SPEC, 2, 10, salts=7)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_items_by_data(crowd, rows):
    events, _, _, _ = crowd
    assert declared_items(events, "item") == ["a", "b", "c", "d"]
    assert rows(feature_index(events, "item")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_vectors_fill_missing_values(spark):
    wide = spark.createDataFrame([(1, 1, None, 2.0)], "e long, label int, x double, y double")
    row = assemble_vectors(wide, ["x", "y"], keep=["e"]).head()
    assert row.e == 1 and row.label == 1.0 and list(row.features.toArray()) == [0.0, 2.0]


def test_events_are_reduced_before_they_are_shuffled_again(crowd, stays):
    events, index, _, _ = crowd
    plan = feature_table(index, events, stays, SPEC, 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan and "Python" not in plan
