from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortspark.functions import (
    age_in_years,
    apply_threshold,
    category_code,
    first_present,
    in_observation_window,
    like_any,
    not_like_any,
    null_to_epoch,
    parse_number,
    replace_sentinel,
    to_time,
    vector_element,
    within_hours,
)

T0 = datetime(2020, 3, 1, 12, 0, 0)


def only(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_age_is_rounded_decimal_years(spark):
    df = spark.sql("SELECT DATE '2020-01-01' AS at, DATE '2005-01-01' AS birth")
    assert only(df, age_in_years("at", "birth")) == [15.0]
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-01 23:59:59' AS at, DATE '2005-01-06' AS birth")
    assert only(df, age_in_years("at", "birth")) == [float(round(Decimal(5473) / Decimal("365.242"), 2))]


@pytest.mark.parametrize(
    "later, hours, expected",
    [
        (datetime(2020, 3, 2, 12, 0, 0), 24.0, True),
        (datetime(2020, 3, 2, 12, 0, 0, 1000), 24.0, False),
        (datetime(2020, 3, 2, 12, 0, 0, 999), 24.0, True),
        (datetime(2020, 3, 4, 12, 0, 0), 72.0, True),
        (datetime(2020, 3, 4, 12, 0, 0, 1000), 72.0, False),
        (datetime(2020, 3, 1, 11, 0, 0), 24.0, True),
    ],
)
def test_within_hours_compares_milliseconds(spark, later, hours, expected):
    df = spark.createDataFrame([(T0, later)], "a timestamp_ntz, b timestamp_ntz")
    assert only(df, within_hours("b", "a", hours)) == [expected]


def test_observation_window_compares_whole_seconds(spark):
    index = datetime(2020, 3, 3, 0, 0, 0)
    times = [
        (datetime(2020, 3, 2, 16, 0, 0), True),
        (datetime(2020, 3, 2, 16, 0, 0, 999999), True),
        (datetime(2020, 3, 2, 16, 0, 1), False),
        (datetime(2020, 3, 1, 16, 0, 0), True),
        (datetime(2020, 3, 1, 15, 59, 59), False),
    ]
    df = spark.createDataFrame([(index, t) for t, _ in times], "i timestamp, t timestamp")
    assert only(df, in_observation_window("i", "t", 8, 24)) == [e for _, e in times]


def test_null_replacements(spark):
    df = spark.createDataFrame([(None, T0), (T0, None)], "a timestamp, b timestamp")
    assert only(df, first_present("a", "b")) == [T0, T0]
    assert only(df, null_to_epoch("a").cast("timestamp_ntz")) == [datetime(1970, 1, 1), T0]


def test_parse_number(spark):
    df = spark.createDataFrame([("1,234.5",), ("x",), (None,), (" 7 ",)], "c string")
    got = only(df, parse_number("c"))
    assert got[0] == 1234.5 and got[3] == 7.0
    assert got[1] != got[1] and got[2] != got[2]


def test_codes_sentinels_thresholds(spark):
    df = spark.createDataFrame([("F", 300.0), ("M", 299.0), (None, None)], "g string, a double")
    assert only(df, category_code("g")) == [0.0, 1.0, 1.0]
    assert only(df, replace_sentinel("a")) == [90.0, 299.0, None]
    assert only(spark.createDataFrame([(0.5,), (0.5000001,)], "p double"), apply_threshold("p")) == [0, 1]


def test_vector_element(spark):
    df = spark.createDataFrame([(Vectors.dense(1.0, 2.0),), (Vectors.sparse(2, [0], [3.0]),)], ["v"])
    assert only(df, vector_element("v", 1)) == [2.0, 0.0]


def test_to_time_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("2020-03-01 12:00:00",), ("soon",)], "c string")
    assert only(df, to_time("c").cast("timestamp_ntz")) == [T0, None]


def test_patterns(spark):
    names = [("Imipenem",), ("cefixime",), ("CEFIXIME SUSP",), (None,), ("amikacin",)]
    df = spark.createDataFrame(names, "d string")
    patterns = ["%Imipenem%", "%cefixime %", "%amikacin%", "%amikacin%"]
    assert [r[0] for r in df.where(like_any("d", patterns)).collect()] == ["CEFIXIME SUSP", "amikacin"]
    assert [r[0] for r in df.where(not_like_any("d", patterns)).collect()] == ["Imipenem", "cefixime"]
    assert [r[0] for r in df.where(like_any("d", ["%Imi%"], lower=False)).collect()] == ["Imipenem"]
    assert df.where(like_any("d", [])).count() == 0
    plan = df.where(like_any("d", patterns))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_long_pattern_lists_plan_as_substring_searches(spark):
    from cohortspark.plans.fixed_values import ANTIBIOTIC_PATTERNS

    df = spark.createDataFrame([("Vancomycin",), ("saline",)], "d string").where(like_any("d", ANTIBIOTIC_PATTERNS))
    assert [r[0] for r in df.collect()] == ["Vancomycin"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "LIKE" not in plan


def test_expressions_need_no_python_worker(spark):
    df = spark.range(1).select(F.lit("1,0").alias("c"), F.current_timestamp().alias("t"))
    df = df.select(parse_number("c").alias("x"), within_hours("t", "t", 1).alias("y"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
