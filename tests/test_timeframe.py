import random
from datetime import datetime, timedelta

import pytest

from cohortspark.operators.timeframe import (
    first_event_time,
    index_dates,
    label_counts,
    pair_first_events,
    table_counts,
)

T0 = datetime(2020, 1, 1)
H = timedelta(hours=1)
MS = timedelta(milliseconds=1)


def build(spark, stays, a, b, **options):
    frames = [
        spark.createDataFrame(stays, "e long, out timestamp"),
        spark.createDataFrame(a, "e long, t timestamp"),
        spark.createDataFrame(b, "e long, t timestamp"),
    ]
    return index_dates(*frames, entity="e", out_time="out", a_time="t", b_time="t", **options)


def stepwise(stays, a, b):
    """The rules one by one: first events, who comes first, any follow-up within its limit."""
    found = {}
    for e in {e for e, _ in a} & {e for e, _ in b}:
        times_a, times_b = [t for k, t in a if k == e], [t for k, t in b if k == e]
        first_a, first_b = min(times_a), min(times_b)
        if first_b < first_a:
            if any(t - first_b <= 24 * H for t in times_a):
                found[e] = first_b
        elif any(t - first_a <= 72 * H for t in times_b):
            found[e] = first_a
    return sorted({(e, found.get(e, out), int(e in found)) for e, out in stays})


BOUNDARIES = {
    1: (T0 + 24 * H, T0, T0, 1),
    2: (T0 + 24 * H + MS, T0, None, 0),
    3: (T0, T0 + 72 * H, T0, 1),
    4: (T0, T0 + 72 * H + MS, None, 0),
    5: (T0 + 5 * H, T0 + 5 * H, T0 + 5 * H, 1),
}


def test_boundaries_and_single_kinds(spark, rows):
    out = T0 + 500 * H
    a = [(e, case[0]) for e, case in BOUNDARIES.items()] + [(6, T0)]
    b = [(e, case[1]) for e, case in BOUNDARIES.items()] + [(7, T0)]
    stays = [(e, out) for e in range(1, 9)]
    expected = [(e, case[2] or out, case[3]) for e, case in BOUNDARIES.items()]
    expected += [(6, out, 0), (7, out, 0), (8, out, 0)]
    assert rows(build(spark, stays, a, b)) == sorted(expected, key=repr)


def test_grain_of_cases_and_controls(spark, rows):
    """Two stays of a case collapse to one row; a control keeps one per different out-time."""
    stays = [(1, T0 + 9 * H), (1, T0 + 20 * H), (2, T0 + 9 * H), (2, T0 + 20 * H), (2, T0 + 20 * H), (None, T0)]
    index = build(spark, stays, [(1, T0)], [(1, T0 + H)])
    assert rows(index) == sorted([(1, T0, 1), (2, T0 + 9 * H, 0), (2, T0 + 20 * H, 0)], key=repr)
    assert rows(label_counts(index)) == [(2, 1, 3)]


def test_epoch_start_turns_a_case_into_a_control(spark, rows):
    epoch = datetime(1970, 1, 1)
    out = T0 + 9 * H
    assert rows(build(spark, [(1, out)], [(1, T0), (1, epoch)], [(1, T0 + H)])) == [(1, out, 0)]


@pytest.mark.parametrize("salts", [None, 1, 5])
def test_closed_form_equals_stepwise_rules(spark, rows, salts):
    rng = random.Random(7)

    def some(entities, most):
        grid = [H * g for g in (0, 1, 12, 24, 25, 48, 72, 73, 96)] + [24 * H + MS, 72 * H + MS]
        return [(e, T0 + rng.choice(grid)) for e in entities for _ in range(rng.randint(0, most))]

    entities = range(600)
    a, b = some(entities, 3), some(entities, 3)
    stays = [(e, T0 + 200 * H + H * rng.randint(0, 3)) for e in entities for _ in range(rng.randint(1, 3))]
    assert rows(build(spark, stays, a, b, salts=salts)) == sorted(stepwise(stays, a, b), key=repr)


def test_first_times_and_pairs(spark, rows):
    a = spark.createDataFrame([(1, T0 + H), (1, T0), (2, T0), (None, T0)], "e long, t timestamp")
    b = spark.createDataFrame([(1, T0 + 3 * H), (3, T0)], "e long, u timestamp_ntz")
    assert rows(first_event_time(a, "e", "t")) == [(1, T0), (2, T0)]
    assert rows(pair_first_events(a, b, "e", "t", "u")) == [(1, T0, T0 + 3 * H)]


def test_pairs_take_one_shuffle_with_partial_minima(spark):
    a = spark.range(100).selectExpr("id % 7 AS e", "timestamp_seconds(id) AS t")
    plan = pair_first_events(a, a, "e", "t", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan and "Join" not in plan


def test_table_counts(spark, rows):
    assert rows(table_counts(x=spark.range(3), y=spark.range(0))) == [("x", 3), ("y", 0)]
