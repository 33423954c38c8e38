import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from cohortspark.operators.evaluation import (
    area_metrics,
    auprc,
    auroc,
    best_f_threshold,
    binary_metrics,
    f_measure_points,
    metric_rows,
    pr_points,
    roc_points,
    threshold_counts,
    weighted_metrics,
)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    data = []
    for _ in range(900):
        score = round(rng.random(), 2)
        data.append((score, float(rng.random() < score), float(score > 0.6), rng.choice("uv")))
    return spark.createDataFrame(data, "score double, label double, prediction double, g string").cache(), data


def test_curves(scored):
    df, data = scored
    counts = threshold_counts(df, ranges=5)
    positives = sum(y for _, y, _, _ in data)
    expected = {}
    for cut in {s for s, _, _, _ in data}:
        above = [y for s, y, _, _ in data if s >= cut]
        tp, fp = sum(above), len(above) - sum(above)
        expected[cut] = (fp / (len(data) - positives), tp / positives, tp / (tp + fp), 2 * tp / (tp + fp + positives))
    roc = {r.threshold: (r.fpr, r.tpr) for r in roc_points(counts).collect()}
    pr = {r.threshold: (r.recall, r.precision) for r in pr_points(counts).collect()}
    f = {r.threshold: r.f_measure for r in f_measure_points(counts).collect()}
    for cut, (fpr, tpr, precision, measure) in expected.items():
        assert roc[cut] == pytest.approx((fpr, tpr))
        assert pr[cut] == pytest.approx((tpr, precision))
        assert f[cut] == pytest.approx(measure)
    assert roc.pop(float("inf")) == (0.0, 0.0) and pr.pop(float("inf")) == (0.0, 1.0)
    assert len(roc) == len(pr) == len(expected)
    best = best_f_threshold(counts).head()
    top = max(m for *_, m in expected.values())
    assert best.f_measure == pytest.approx(top)
    assert best.threshold == max(c for c, e in expected.items() if e[3] == pytest.approx(top))


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_areas_equal_spark_evaluator(scored, ranges):
    df, _ = scored
    counts = threshold_counts(df, ranges=ranges)
    for area, name in ((auroc, "areaUnderROC"), (auprc, "areaUnderPR")):
        expected = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=name, numBins=0).evaluate(df)
        assert area(counts).head()[0] == pytest.approx(expected)


def test_areas_by_group(scored):
    df, _ = scored
    both = {r.g: (r.auroc, r.auprc) for r in area_metrics(threshold_counts(df, by=["g"]), ["g"]).collect()}
    for group, values in both.items():
        one = area_metrics(threshold_counts(df.where(F.col("g") == group))).head()
        assert values == pytest.approx(tuple(one))
    assert set(both) == {"u", "v"}


def test_weighted_metrics_equal_spark_evaluator(scored):
    df, _ = scored
    got = weighted_metrics(df).head()
    for name, column in (
        ("accuracy", "accuracy"), ("f1", "f1"), ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"),
    ):
        assert got[column] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df))


def test_binary_metrics(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "label int, prediction int")
    assert tuple(binary_metrics(df).head()) == pytest.approx((0.6, 0.5, 0.5, 0.5))
    nobody = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(binary_metrics(nobody).head()) == (0.5, 0.0, 0.0, 0.0)
    long = metric_rows(binary_metrics(nobody), ["accuracy", "f1"])
    assert rows(long) == [("accuracy", 0.5), ("f1", 0.0)]


def test_degenerate_scores(spark):
    same = spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1)], "score double, label int")
    assert tuple(area_metrics(threshold_counts(same)).head()) == (0.5, 0.5)
    one_class = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert tuple(area_metrics(threshold_counts(one_class)).head()) == (0.0, 1.0)
    none = spark.createDataFrame([(0.5, 0), (0.7, 0)], "score double, label int")
    assert tuple(area_metrics(threshold_counts(none)).head()) == (0.0, 0.0)
