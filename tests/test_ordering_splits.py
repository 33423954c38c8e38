import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators.ordering import global_row_number, order_ranges, running_totals
from cohortspark.operators.splits import (
    assign_split,
    fold_sizes,
    kfold_assign,
    stratified_kfold_assign,
    train_test_split,
)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    values = rng.sample(range(100000), 1000) + [float("inf"), float("-inf")]
    data = [(float(v), rng.randint(0, 9), rng.choice("xyz")) for v in values]
    return spark.createDataFrame(data, "k double, n int, g string").repartition(5).cache(), data


@pytest.mark.parametrize("ranges", [None, 1, 2, 7, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(numbers, ranges, descending):
    df, data = numbers
    got = running_totals(df, "k", {"s": F.col("n")}, descending=descending, ranges=ranges, totals=True)
    total, expected = 0, []
    for k, n, _ in sorted(data, reverse=descending):
        total += n
        expected.append((k, total))
    found = got.collect()
    assert sorted(((r.k, r.s) for r in found), reverse=descending) == expected
    assert {r.total_s for r in found} == {total}


def test_running_totals_by_group(numbers):
    df, data = numbers
    got = running_totals(df, "k", {"s": F.col("n"), "c": F.lit(1)}, by=["g"], ranges=6)
    expected = {}
    for group in "xyz":
        total = count = 0
        for k, n, _ in sorted(d for d in data if d[2] == group):
            total, count = total + n, count + 1
            expected[group, k] = (total, count)
    assert {(r.g, r.k): (r.s, r.c) for r in got.collect()} == expected


def test_ranges_are_even_also_for_skewed_values(spark):
    df = spark.range(0, 20000).select(F.pow(F.col("id").cast("double"), F.lit(6)).alias("k"))
    sizes = [r["count"] for r in order_ranges(df, "k", 10).groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 20000 / 10


def test_row_numbers_keep_every_row(spark):
    df = spark.createDataFrame([(3.0,), (None,), (float("nan"),), (1.0,)], "k double")
    got = {str(r.k): r.row_number for r in global_row_number(df, "k", ranges=4).collect()}
    assert got == {"None": 1, "1.0": 2, "3.0": 3, "nan": 4}


@pytest.mark.parametrize("rows_, folds", [(23, 5), (25, 5), (3, 5), (1, 2), (100, 7)])
def test_contiguous_folds(spark, rows_, folds):
    df = spark.range(0, rows_).select((F.col("id") * 3 + 1).alias("k"))
    got = sorted((r.k, r.fold) for r in kfold_assign(df, "k", folds).collect())
    sizes = [rows_ // folds + (1 if f < rows_ % folds else 0) for f in range(folds)]
    assert [f for _, f in got] == [f for f in range(folds) for _ in range(sizes[f])]


def test_stratified_folds(spark):
    data = [(i, 1 if i % 10 == 0 else 0) for i in range(997)] + [(2000, None)]
    df = spark.createDataFrame(data, "k long, label int")
    got = stratified_kfold_assign(df, "k", "label", 5, seed=9)
    expected = {}
    for label in (0, 1, None):
        keys = sorted((hashlib.md5(f"9:{k}".encode()).hexdigest(), k) for k, y in data if y == label)
        expected.update({k: rank % 5 for rank, (_, k) in enumerate(keys)})
    assert {r.k: r.fold for r in got.collect()} == expected
    per_label = fold_sizes(got, ["label", "fold"]).where("label = 0").collect()
    assert max(r.n_rows for r in per_label) - min(r.n_rows for r in per_label) <= 1


def test_rows_without_key_stay(spark):
    df = spark.createDataFrame([(1, 0), (None, 0), (None, 1), (2, None), (3, 1)], "k long, label int")
    train, test = train_test_split(df, "k")
    assert train.count() + test.count() == 5
    assert stratified_kfold_assign(df, "k", "label", 2).count() == 5


def test_folds_of_text_keys(spark):
    keys = sorted(f"{w}{i}" for w in ("a", "é", "Z", "") for i in range(25))
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = sorted((r.k, r.fold) for r in kfold_assign(df, "k", 7, ranges=4).collect())
    sizes = [len(keys) // 7 + (1 if f < len(keys) % 7 else 0) for f in range(7)]
    assert got == list(zip(keys, [f for f in range(7) for _ in range(sizes[f])]))


def test_split_depends_on_the_key_only(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    one = {r.k: r.is_train for r in assign_split(df, "k").collect()}
    other = {r.k: r.is_train for r in assign_split(df.repartition(7), "k").collect()}
    assert one == other and abs(sum(one.values()) / 3000 - 0.67) < 0.03
    train, test = train_test_split(df, "k")
    assert train.count() == sum(one.values()) and train.count() + test.count() == 3000
    train, test = train_test_split(df, None)
    assert train.count() + test.count() == 3000


def test_scaled_columns(spark, rows):
    from cohortspark.operators.records import scale_columns

    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "a double, b double")
    half = 2 ** -0.5
    got = scale_columns(df, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [(pytest.approx(half), 0.0), (pytest.approx(3 * half), 0.0), (None, None)]
