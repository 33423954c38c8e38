import math
import random
import struct
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.sortable import NOT_A_NUMBER, order_key, pair_key, share_key, sortable_double


def bits(x):
    if math.isnan(x):
        return NOT_A_NUMBER
    size = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -size if x < 0 else size


def numbers(seed, n=3000):
    rng = random.Random(seed)
    out = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    for e in range(-1074, 1024, 7):
        power = math.ldexp(1.0, e)
        out += [power, math.nextafter(power, 0), math.nextafter(power, math.inf), -power]
    out += [math.ldexp(rng.uniform(-1, 1), rng.randint(-1070, 1024)) for _ in range(n)]
    return [x for x in out]


def test_numbers_are_their_bits(spark):
    values = numbers(1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double")
    got = {r.i: r.s for r in df.select("i", sortable_double("x").alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [bits(x) for x in values]
    assert spark.range(1).select(sortable_double(F.lit(None).cast("double"))).head()[0] is None


def spark_order(x):
    """Spark's order of a number: missing first, then by value, NaN last; -0.0 is 0.0."""
    return (0, 0.0) if x is None else (2, 0.0) if math.isnan(x) else (1, x + 0.0)


@pytest.mark.parametrize("kind", ["timestamp", "date", "int"])
def test_pairs_order_like_structs(spark, kind):
    rng = random.Random(2)
    seconds = numbers(3, 50) + [None]
    firsts = {
        "timestamp": [None, datetime(1, 1, 2), datetime(9999, 12, 30), *[datetime(2020, 1, 1) + timedelta(microseconds=k) for k in range(3)]],
        "date": [None, date(1, 1, 1), date(2020, 1, 1), date(9999, 12, 31)],
        "int": [None, -(2**31), -1, 0, 2**31 - 1],
    }[kind]
    data = [(rng.choice(firsts), rng.choice(seconds)) for _ in range(800)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], f"i long, a {kind}, b double")
    keys = {r.i: r.k for r in df.select("i", pair_key(df, "a", "b").alias("k")).collect()}
    assert None not in keys.values()

    def order(i):
        a, b = data[i]
        return (a is not None, a if a is not None else firsts[1], spark_order(b))

    ranked = sorted(range(len(data)), key=order)
    for i, j in zip(ranked, ranked[1:]):
        assert (keys[i] < keys[j]) == (order(i) < order(j)) and (keys[i] == keys[j]) == (order(i) == order(j))


def test_types_without_a_number_fall_back_to_a_struct(spark):
    df = spark.createDataFrame([("a", "b", 1)], "x string, y string, z long")
    assert df.select(pair_key(df, "x", "z").alias("k")).schema["k"].dataType.typeName() == "struct"
    assert df.select(order_key(df, ["z"]).alias("k")).schema["k"].dataType.typeName() == "decimal"
    assert df.select(order_key(df, ["x", "y", "z"]).alias("k")).schema["k"].dataType.typeName() == "struct"


def test_shares(spark):
    data = [(s, t) for s in (0.0, 5e-324, 0.3, 1.0) for t in (-math.inf, -1e300, -0.0, 2.0, math.inf)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i long, s double, t double")
    keys = [r.k for r in df.select("i", share_key("s", "t").alias("k")).orderBy("i").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
