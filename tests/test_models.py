import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from cohortspark.plans import models


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(2)
    data = []
    for key in range(240):
        label = float(rng.random() < 0.4)
        data.append((key, label, Vectors.dense(label * 2 + rng.gauss(0, 1), rng.gauss(0, 5), 7.0)))
    return spark.createDataFrame(data, ["key", "label", "features"]).coalesce(1).cache()


def values(metrics):
    return {(r.model, r.metric): r.value for r in metrics.collect()}


def test_scaling_divides_by_spread_and_zeroes_constants(features):
    (scaled,) = models.scale_unit_std(features)
    got = [r.scaled.toArray() for r in scaled.collect()]
    column = [v[1] for v in got]
    mean = sum(column) / len(column)
    assert sum((v - mean) ** 2 for v in column) / (len(column) - 1) == pytest.approx(1.0)
    assert {v[2] for v in got} == {0.0}


def test_grids_have_the_stated_sizes():
    from pyspark.ml.classification import (
        GBTClassifier,
        LogisticRegression,
        MultilayerPerceptronClassifier,
        RandomForestClassifier,
    )

    sizes = {
        name: len(models.param_grid(estimator, models.GRIDS[name]["full"]))
        for name, estimator in (
            ("logistic", LogisticRegression()), ("forest", RandomForestClassifier()), ("gbt", GBTClassifier()),
            ("mlp", MultilayerPerceptronClassifier()),
        )
    }
    assert sizes == {"logistic": 16, "forest": 54, "gbt": 4, "mlp": 2}


def test_logistic_search(features):
    fitted = models.fit_logistic_cv(features, "key", "small")
    got = values(fitted.metrics)
    assert {m for _, m in got} == {"accuracy", "f1", "weighted_precision", "weighted_recall", "auroc", "auprc"}
    expected = BinaryClassificationEvaluator(numBins=0).evaluate(fitted.predictions)
    assert got["LogisticRegression", "auroc"] == pytest.approx(expected)
    assert got["LogisticRegression", "auroc"] > 0.8


def test_random_split_is_an_option(features):
    got = values(models.fit_forest_cv(features, None, "small").metrics)
    assert got["RandomForest", "auroc"] > 0.75


def test_plain_regressions_and_their_thresholds(features):
    fitted = models.fit_logistic_plain(features)
    assert set(fitted) == {"binomial", "multinomial"}
    for name, model in fitted.items():
        got = values(models.logistic_summary(model, name))
        assert got[name, "threshold"] == model.getThreshold()
        assert got[name, "auroc"] > 0.8
        points = model.summary.fMeasureByThreshold.collect()  # fewer rows than bins here
        top = max(r["F-Measure"] for r in points)
        assert model.getThreshold() == max(r.threshold for r in points if r["F-Measure"] == top)
        roc = models.summary_roc(model).collect()
        ends = {(r.fpr, r.tpr) for r in roc}
        assert {(0.0, 0.0), (1.0, 1.0)} <= ends


def test_fold_reports(features):
    for report in (models.kfold_metrics, models.stratified_kfold_metrics):
        got = {m: v for (_, m), v in values(report(features, "key", folds=3, trees=5)).items()}
        assert set(got) == {"accuracy", "precision", "recall", "f1", "auroc"}
        assert got["auroc"] > 0.75 and 0.5 < got["accuracy"] < 1.0


def test_forest_report(features):
    got = {m: v for (_, m), v in values(models.forest_report(features, "key", trees=10)).items()}
    assert got["auroc"] > 0.75


def test_other_searches_and_the_comparison(features):
    got = values(models.fit_gbt_cv(features, "key", "small", iterations=3).metrics)
    assert got["GradientBoostedTrees", "auroc"] > 0.75
    got = values(models.fit_mlp_cv(features, "key", "small", width=3, scaled=True).metrics)
    assert got["MultiLayerPerceptron", "auroc"] > 0.75
    got = values(models.compare_models(features, "key", "small", width=3, iterations=3))
    assert len(got) == 24 and all(0 <= v <= 1 for v in got.values())


def test_reports_by_window(features):
    from pyspark.sql import functions as F

    swept = features.withColumn("pred_hours", (F.col("key") % 2) + 1)
    rows = models.metrics_by_window(swept, "key", trees=5).collect()
    assert {(r.pred_hours, r.metric) for r in rows} == {(h, m) for h in (1, 2) for m in ("accuracy", "precision", "recall", "f1", "auroc")}
    rows = models.fold_metrics_by_window(swept, "key", folds=3, trees=3).collect()
    assert len(rows) == 2 * 2 * 5 and all(0 <= r.value <= 1 for r in rows)
    one = {(r.model, r.metric): r.value for r in rows if r.pred_hours == 1}
    alone = values(models.kfold_metrics(swept.where("pred_hours = 1").drop("pred_hours"), "key", folds=3, trees=3))
    assert {k: v for k, v in one.items() if k[0] == "RandomForest/kfold"} == pytest.approx(alone, abs=0.15)  # bootstraps differ


def test_every_score_is_a_threshold(spark):
    rng = random.Random(4)
    data = [(float(i % 3 == 0), Vectors.dense(i % 3 + rng.gauss(0, 1))) for i in range(20000)]
    df = spark.createDataFrame(data, ["label", "features"])
    model = models.fit_logistic_plain(df)["binomial"]
    distinct = models.training_counts(model).count()
    assert distinct == 20000 and models.summary_roc(model).count() == distinct + 1


def test_scales_of_folds_equal_the_scaler_far_from_zero(spark):
    from pyspark.ml.feature import StandardScaler
    from pyspark.sql import functions as F

    rng = random.Random(6)
    data = [(i, i % 3, float(i % 2), Vectors.dense(1e7 + rng.gauss(0, 3), rng.gauss(-5e5, 0.1), 4.0)) for i in range(300)]
    df = spark.createDataFrame(data, ["key", "fold", "label", "features"])
    moments = models.fold_moments(df, ["fold"])
    for fold in range(3):
        scaler = StandardScaler(inputCol="features", outputCol="o", withStd=True, withMean=False)
        fitted = scaler.fit(df.where(F.col("fold") != fold))
        want = [1 / s if s else 0.0 for s in fitted.std.toArray()]
        assert models.other_folds_scale(moments, (), fold) == pytest.approx(want, rel=1e-9)


def test_moments_add_up_with_empty_parts():
    import numpy as np

    none = models.Moments(0, np.zeros(1), np.zeros(1))
    some = models.Moments(2, np.array([3.0]), np.array([2.0]))
    assert (none + some).mean == 3.0 and (some + none).squares == 2.0 and (none + none).n == 0
    assert none.inverse_deviation() == 0.0


def test_settings_of_plain_regressions(features):
    fitted = models.fit_logistic_plain(features, {"free": {"regParam": 0.0, "maxIter": 100}})
    assert set(fitted) == {"free"} and values(models.logistic_summary(fitted["free"], "free"))["free", "auroc"] > 0.8
