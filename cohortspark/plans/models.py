"""Fitting and comparing Spark ML classifiers on ``(key, label, features)`` tables.

Fits and grid searches are loops on the driver that only start Spark jobs; rows stay on the executors. Results are
tables of ``(model, metric, value)`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import vector_element
from cohortspark.operators.evaluation import (
    area_metrics,
    auroc,
    best_f_threshold,
    binary_metrics,
    metric_rows,
    roc_points,
    threshold_counts,
    weighted_metrics,
)
from cohortspark.operators.splits import kfold_assign, stratified_kfold_assign, train_test_split
from cohortspark.sources.checkpoints import durable

# Shares, seeds and the number of folds.
TRAIN_SHARE = 0.67
SPLIT_SEED = 11
TREE_SEED = 207336481
FOREST_SEED = 545510477
SEARCH_FOLDS = 3
REPORT_FOLDS = 5

# The parameters searched. "small" is a part of each, for quick trials.
GRIDS: dict[str, dict[str, dict[str, list[Any]]]] = {
    "logistic": {
        "full": {
            "regParam": [0.1, 0.01],
            "fitIntercept": [True, False],
            "elasticNetParam": [0.0, 0.5],
            "tol": [0.01, 0.05],
        },
        "small": {"regParam": [0.1, 0.01]},
    },
    "forest": {
        "full": {
            "maxBins": [25, 31, 49],
            "impurity": ["gini", "entropy"],
            "maxDepth": [4, 6, 8],
            "numTrees": [20, 50, 80],
        },
        "small": {"maxDepth": [4], "numTrees": [20]},
    },
    "gbt": {"full": {"maxBins": [23, 31], "maxDepth": [3, 5]}, "small": {"maxDepth": [3]}},
    "mlp": {"full": {"tol": [0.001, 0.01]}, "small": {"tol": [0.01]}},
}


# The two plain regressions.
PLAIN: dict[str, dict[str, Any]] = {
    "binomial": {"maxIter": 50, "regParam": 0.01, "elasticNetParam": 0.8, "tol": 0.05},
    "multinomial": {"maxIter": 50, "regParam": 0.001, "elasticNetParam": 1.0, "tol": 0.05, "family": "multinomial"},
}


@dataclass
class Fitted:
    """A fitted model with its predictions on the test split and the metrics of these."""

    model: Model
    predictions: DataFrame
    metrics: DataFrame


def scale_unit_std(
    train: DataFrame, *others: DataFrame, features: str = "features", output: str = "scaled"
) -> list[DataFrame]:
    """Divide every feature by its standard deviation in ``train``; a constant feature becomes 0."""
    scaler = StandardScaler(inputCol=features, outputCol=output, withStd=True, withMean=False).fit(train)
    return [scaler.transform(df) for df in (train, *others)]


def compact(df: DataFrame) -> DataFrame:
    """Store rows that many fits read, in as few partitions as their size asks for."""
    return durable(df.hint("rebalance"))


def param_grid(estimator: Estimator, values: dict[str, list[Any]]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), options)
    return builder.build()


def cross_validate(
    train: DataFrame, estimator: Estimator, grid: list[dict], *, fold: str | None = None, folds: int = SEARCH_FOLDS,
    parallelism: int = 2, seed: int = SPLIT_SEED,
) -> Model:
    """The best model of a grid by area under the ROC curve, fitted again on all of ``train``.

    ``fold`` names the column with the fold of each row; without one Spark draws the folds at random.
    """
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0),  # all thresholds, not a thousand
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    if fold is not None:
        search.setFoldCol(fold)
    return search.fit(train).bestModel


def prediction_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, weighted F1, precision and recall, and both areas, of predictions with raw scores, per model."""
    scored = predictions.withColumn("_score", vector_element("rawPrediction", 1))
    weighted = metric_rows(
        weighted_metrics(scored, by=by), ["accuracy", "f1", "weighted_precision", "weighted_recall"], by
    )
    areas = metric_rows(area_metrics(threshold_counts(scored, score="_score", by=by), by), ["auroc", "auprc"], by)
    return weighted.unionByName(areas)


def forest_metrics(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, and the area under the ROC curve of its probability."""
    scored = predictions.withColumn("_score", vector_element("probability", 1))
    hard = metric_rows(binary_metrics(scored, by=by), ["accuracy", "precision", "recall", "f1"], by)
    area = metric_rows(area_metrics(threshold_counts(scored, score="_score", by=by), by), ["auroc"], by)
    return hard.unionByName(area)


@dataclass
class Prepared:
    """A train split with scaled features and folds, and a test split scaled alike; both written to storage."""

    train: DataFrame
    test: DataFrame
    has_folds: bool


def prepare(features: DataFrame, key: str | None = None, folds: int = SEARCH_FOLDS) -> Prepared:
    """Split by the key (or at random), scale by the spread of the train rows and deal these out to folds."""
    features = compact(features)  # scaling, splitting and dealing out read it again
    train, test = scale_unit_std(*train_test_split(features, key, TRAIN_SHARE, SPLIT_SEED))
    if key is not None:
        train = stratified_kfold_assign(train, key, "label", folds, SPLIT_SEED, "fold")
    return Prepared(compact(train), compact(test), key is not None)


def _search(
    name: str, data: Prepared, estimator: Estimator, grid: dict[str, list[Any]], parallelism: int
) -> tuple[Model, DataFrame]:
    """The best model, and its predictions on the test rows."""
    model = cross_validate(
        data.train, estimator, param_grid(estimator, grid), fold="fold" if data.has_folds else None,
        parallelism=parallelism,
    )
    predicted = model.transform(data.test).select(F.lit(name).alias("model"), "label", "prediction", "rawPrediction")
    return model, predicted


def _fitted(model: Model, predictions: DataFrame) -> Fitted:
    # Several aggregations read the predictions.
    predictions = durable(predictions)
    return Fitted(model, predictions, prediction_metrics(predictions))


def _logistic(data: Prepared, grid: str, parallelism: int) -> tuple[Model, DataFrame]:
    estimator = LogisticRegression(featuresCol="scaled", maxIter=50)
    return _search("LogisticRegression", data, estimator, GRIDS["logistic"][grid], parallelism)


def _forest(data: Prepared, grid: str, parallelism: int) -> tuple[Model, DataFrame]:
    estimator = RandomForestClassifier(featuresCol="scaled", seed=TREE_SEED)
    return _search("RandomForest", data, estimator, GRIDS["forest"][grid], parallelism)


def _gbt(data: Prepared, grid: str, parallelism: int, iterations: int = 50) -> tuple[Model, DataFrame]:
    estimator = GBTClassifier(featuresCol="scaled", maxIter=iterations, seed=TREE_SEED)
    return _search("GradientBoostedTrees", data, estimator, GRIDS["gbt"][grid], parallelism)


def _mlp(data: Prepared, grid: str, parallelism: int, width: int, scaled: bool = False) -> tuple[Model, DataFrame]:
    estimator = MultilayerPerceptronClassifier(
        featuresCol="scaled" if scaled else "features", layers=[width, 8, 5, 2], blockSize=128, maxIter=100,
        seed=TREE_SEED,
    )
    return _search("MultiLayerPerceptron", data, estimator, GRIDS["mlp"][grid], parallelism)


def fit_logistic_cv(features: DataFrame, key: str | None = None, grid: str = "full", parallelism: int = 2) -> Fitted:
    return _fitted(*_logistic(prepare(features, key), grid, parallelism))


def fit_forest_cv(features: DataFrame, key: str | None = None, grid: str = "full", parallelism: int = 2) -> Fitted:
    return _fitted(*_forest(prepare(features, key), grid, parallelism))


def fit_gbt_cv(
    features: DataFrame, key: str | None = None, grid: str = "full", parallelism: int = 2, iterations: int = 50
) -> Fitted:
    return _fitted(*_gbt(prepare(features, key), grid, parallelism, iterations))


def fit_mlp_cv(
    features: DataFrame, key: str | None = None, grid: str = "full", parallelism: int = 2, width: int = 12,
    scaled: bool = False,
) -> Fitted:
    """A network with hidden layers of 8 and 5; it is fitted on unscaled features unless told otherwise."""
    return _fitted(*_mlp(prepare(features, key), grid, parallelism, width, scaled))


def compare_models(
    features: DataFrame, key: str | None = None, grid: str = "full", parallelism: int = 2, width: int = 12,
    iterations: int = 50,
) -> DataFrame:
    """Metrics of all four classifiers, fitted and tested on the same rows."""
    data = prepare(features, key)
    tested = [
        _logistic(data, grid, parallelism)[1],
        _gbt(data, grid, parallelism, iterations)[1],
        _mlp(data, grid, parallelism, width)[1],
        _forest(data, grid, parallelism)[1],
    ]
    predictions = tested[0]
    for other in tested[1:]:
        predictions = predictions.unionByName(other)
    return prediction_metrics(durable(predictions))


# --- plain logistic regression -----------------------------------------------------------------------------------


def fit_logistic_plain(
    features: DataFrame, settings: Mapping[str, Mapping[str, Any]] | None = None
) -> dict[str, LogisticRegressionModel]:
    """Regressions on all rows, each with its threshold at the best F-measure; binomial and multinomial unless
    ``settings`` names others by their parameters."""
    (scaled,) = scale_unit_std(compact(features))
    models = {name: LogisticRegression(featuresCol="scaled", **params).fit(scaled) for name, params in (settings or PLAIN).items()}
    for model in models.values():
        model.setThreshold(best_threshold(model))
    return models


def best_threshold(model: LogisticRegressionModel) -> float:
    """The threshold with the largest F-measure on the training rows, the highest of several."""
    return best_f_threshold(training_counts(model)).head()["threshold"]


def training_counts(model: LogisticRegressionModel) -> DataFrame:
    """Counts per distinct probability of class 1 on the training rows."""
    scored = model.summary.predictions.select("label", vector_element("probability", 1).alias("score"))
    return threshold_counts(scored)


def logistic_summary(model: LogisticRegressionModel, name: str) -> DataFrame:
    """Coefficients, intercepts, area under the ROC curve and threshold as ``(model, metric, value)`` rows."""
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(name, f"coefficient_{c}_{f}", float(v)) for c, row in enumerate(matrix) for f, v in enumerate(row)]
    rows += [(name, f"intercept_{c}", float(v)) for c, v in enumerate(intercepts)]
    rows += [(name, "auroc", float(auroc(training_counts(model)).head()["auroc"])), (name, "threshold", float(model.getThreshold()))]
    spark = model.summary.predictions.sparkSession
    return spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE")


def summary_roc(model: LogisticRegressionModel) -> DataFrame:
    """ROC points on the training rows."""
    return roc_points(training_counts(model)).select("fpr", "tpr")


# --- a forest of its own, and k folds ----------------------------------------------------------------------------


def fit_forest(train: DataFrame, test: DataFrame, trees: int = 100, features: str = "features") -> DataFrame:
    """Predictions of a forest fitted without a search: the rows of ``test`` with labels and probabilities."""
    forest = RandomForestClassifier(featuresCol=features, numTrees=trees, seed=FOREST_SEED)
    return forest.fit(train).transform(test)


def forest_report(features: DataFrame, key: str, trees: int = 100, train_share: float = 0.75) -> DataFrame:
    """Metrics of the forest on a held-out split; features are scaled by the spread of the train rows."""
    train, test = train_test_split(compact(features), key, train_share, 0)
    train, test = scale_unit_std(train, test)
    predictions = fit_forest(train, test, trees, "scaled").select(
        F.lit("RandomForest").alias("model"), "label", "prediction", "probability"
    )
    return forest_metrics(durable(predictions))


@dataclass
class Moments:
    """Number, means and sums of squared deviations of feature vectors; those of two sets of rows add up."""

    n: float
    mean: np.ndarray
    squares: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.squares + other.squares + apart**2 * (self.n * other.n / n))

    def inverse_deviation(self) -> np.ndarray:
        """What to multiply features by; 0 for a constant feature."""
        deviation = np.sqrt(self.squares / max(self.n - 1, 1))
        return np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)


def fold_moments(folded: DataFrame, by: Sequence[str], features: str = "features") -> dict[tuple, Moments]:
    """Moments of the rows of each group, in one aggregation that brings a few numbers per group and feature to the driver."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(features)).alias("s")
    rows = folded.groupBy(*by).agg(summary).select(*by, "s.count", "s.mean", "s.variance").collect()
    return {tuple(r[:-3]): Moments(r[-3], r[-2].toArray(), r[-1].toArray() * max(r[-3] - 1, 0)) for r in rows}


def other_folds_scale(moments: dict[tuple, Moments], group: tuple, fold: int) -> np.ndarray:
    """What scales the rows that a model for ``fold`` trains on: those of the group's other folds.

    Moments are added and never subtracted, so features far from zero lose no digits.
    """
    others = [m for key, m in sorted(moments.items()) if key[:-1] == group and key[-1] != fold]
    return reduce(Moments.__add__, others).inverse_deviation()


def _tested_folds(folded: DataFrame, folds: int, trees: int, by: Sequence[str] = ()) -> DataFrame:
    """Predictions for the rows of each fold of each group by a forest fitted on the group's other folds.

    The scales of all folds come from one aggregation.
    """
    folded = compact(folded)
    moments = fold_moments(folded, [*by, "fold"])
    tested = []
    for group in sorted({key[:-1] for key in moments}):
        inside = reduce(lambda c, pair: c & (F.col(pair[0]) == F.lit(pair[1])), zip(by, group), F.lit(True))
        for fold in sorted(key[-1] for key in moments if key[:-1] == group):
            scale = Vectors.dense(other_folds_scale(moments, group, fold))
            scaled = ElementwiseProduct(scalingVec=scale, inputCol="features", outputCol="scaled").transform(folded.where(inside))
            train, test = scaled.where(F.col("fold") != fold), scaled.where(F.col("fold") == fold)
            tested.append(fit_forest(train, test, trees, "scaled").select(*by, "fold", "label", "prediction", "probability"))
    return reduce(DataFrame.unionByName, tested)


def _fold_metrics(folded: DataFrame, folds: int, trees: int, model_name: str) -> DataFrame:
    """Mean over the folds of the metrics of a forest fitted on the others."""
    per_fold = forest_metrics(durable(_tested_folds(folded, folds, trees)), by=["fold"])
    return per_fold.groupBy(F.lit(model_name).alias("model"), "metric").agg((F.sum("value") / folds).alias("value"))


def kfold_metrics(features: DataFrame, key: str, folds: int = REPORT_FOLDS, trees: int = 100) -> DataFrame:
    """Mean metrics over contiguous folds in the order of the key."""
    return _fold_metrics(kfold_assign(durable(features), key, folds), folds, trees, "RandomForest/kfold")


def stratified_kfold_metrics(features: DataFrame, key: str, folds: int = REPORT_FOLDS, trees: int = 100) -> DataFrame:
    """Mean metrics over shuffled folds with equal shares of each label."""
    folded = stratified_kfold_assign(durable(features), key, "label", folds, FOREST_SEED)
    return _fold_metrics(folded, folds, trees, "RandomForest/stratified")


def metrics_by_window(features: DataFrame, key: str, window: str = "pred_hours", trees: int = 100) -> DataFrame:
    """Metrics of a forest per prediction window; ``features`` carries the window of each row."""
    features = compact(features)
    windows = [row[0] for row in features.select(window).distinct().orderBy(window).collect()]
    tested = []
    for hours in windows:
        train, test = train_test_split(features.where(F.col(window) == hours), key, 0.75, 0)
        train, test = scale_unit_std(train, test)
        tested.append(fit_forest(train, test, trees, "scaled").select(window, "label", "prediction", "probability"))
    predictions = tested[0]
    for other in tested[1:]:
        predictions = predictions.unionByName(other)
    named = durable(predictions).withColumn("model", F.lit("RandomForest"))
    return forest_metrics(named, by=["model", window])


def fold_metrics_by_window(
    features: DataFrame, key: str, window: str = "pred_hours", folds: int = REPORT_FOLDS, trees: int = 100
) -> DataFrame:
    """Mean fold metrics of the forest per prediction window, over contiguous and over stratified folds."""
    features = compact(features)
    windows = [row[0] for row in features.select(window).distinct().orderBy(window).collect()]
    dealt: dict[str, Callable[[DataFrame], DataFrame]] = {
        "RandomForest/kfold": lambda df: kfold_assign(df, key, folds),
        "RandomForest/stratified": lambda df: stratified_kfold_assign(df, key, "label", folds, FOREST_SEED),
    }
    folded = [
        deal(features.where(F.col(window) == hours)).withColumn("model", F.lit(name))
        for name, deal in dealt.items()
        for hours in windows
    ]
    tested = _tested_folds(reduce(DataFrame.unionByName, folded), folds, trees, ["model", window])
    per_fold = forest_metrics(durable(tested), by=["model", window, "fold"])
    return per_fold.groupBy("model", window, "metric").agg((F.sum("value") / folds).alias("value"))
