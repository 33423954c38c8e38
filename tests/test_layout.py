import random

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from cohortspark.operators.layout import item_positions, sparse_features, sparse_vectors


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("salts", [None, 3])
def test_vectors_over_all_items(spark, kind, salts):
    rng = random.Random(1)
    items = [f"i{n}" for n in range(500)] if kind == "string" else list(range(-250, 250))
    data = {(k, i): rng.choice([0.0, 1.5, None, -2.0]) for k in range(40) for i in rng.sample(items, rng.randint(0, 60))}
    rows = [(k, k % 2, i, v) for (k, i), v in data.items()] + [(1, 1, None, 9.0)]
    long = spark.createDataFrame(rows, f"k long, label int, item {kind}, value double").repartition(4)
    positions = item_positions(long, "item", ranges=5)
    order = sorted({i for _, i in data})
    assert {r["item"]: (r["position"], r["width"]) for r in positions.collect()} == {i: (n, len(order)) for n, i in enumerate(order)}
    features = sparse_features(long, ["k", "label"], "item", "value", positions, salts)
    place = {i: n for n, i in enumerate(order)}
    want = {}
    for (k, i), v in sorted(data.items(), key=lambda x: place[x[0][1]]):
        if v is not None:
            want.setdefault(k, []).append((place[i], v))
    vectors = sparse_vectors(features.withColumn("label", F.col("label").cast("double")), ["k", "label"])
    got = {r.k: r.features for r in vectors.collect()}
    assert got == {k: SparseVector(len(order), pairs) for k, pairs in want.items()}
    assert vectors.schema["features"].dataType.typeName() == "vectorudt" or "vector" in vectors.schema["features"].dataType.simpleString()


def test_no_plan_orders_all_items_in_one_task_or_has_an_expression_for_each(spark):
    long = spark.range(50_000).select((F.col("id") % 7).alias("k"), F.col("id").alias("item"), F.lit(1.0).alias("value"))
    features = sparse_features(long, ["k"], "item", "value", item_positions(long, "item"))
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and len(plan) < 20_000
    assert features.agg(F.sum(F.size("indices"))).first()[0] == 50_000


def test_no_rows(spark):
    long = spark.createDataFrame([], "k long, item string, value double")
    assert sparse_features(long, ["k"], "item", "value", item_positions(long, "item")).count() == 0
