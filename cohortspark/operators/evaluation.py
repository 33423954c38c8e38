"""Binary and weighted classification metrics, curves and areas as DataFrame aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.sortable import share_key
from cohortspark.operators.ordering import running_totals
from cohortspark.sources.checkpoints import durable


def _ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)))


# --- metrics of hard predictions ---------------------------------------------------------------------------------


def binary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; a metric with an empty denominator is 0."""
    truth, guess = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def weighted_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and F1, precision and recall averaged over classes by their frequency."""
    pairs = df.groupBy(*by, F.col(label).alias("_label"), F.col(prediction).alias("_guess")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    # Each cell of the confusion table counts towards the class it is and the class it was taken for.
    n, zero = F.col("_n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("_label") == F.col("_guess"), n).otherwise(zero)
    as_truth = F.struct(
        F.col("_label").cast("double").alias("cls"), n.alias("actual"), zero.alias("guessed"), hit.alias("hit")
    )
    as_guess = F.struct(
        F.col("_guess").cast("double").alias("cls"), zero.alias("actual"), n.alias("guessed"), zero.alias("hit")
    )
    classes = (
        pairs.select(*by, F.inline(F.array(as_truth, as_guess)))
        .groupBy(*by, "cls")
        .agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    )
    actual, guessed, hits = F.col("actual"), F.col("guessed"), F.col("hit")
    total = F.sum(actual)
    return classes.groupBy(*by).agg(
        (F.sum(hits) / total).alias("accuracy"),
        (F.sum(actual * _ratio(2 * hits, actual + guessed)) / total).alias("f1"),
        (F.sum(actual * _ratio(hits, guessed)) / total).alias("weighted_precision"),
        (F.sum(actual * _ratio(hits, actual)) / total).alias("weighted_recall"),
    )


# --- curves ------------------------------------------------------------------------------------------------------


def threshold_counts(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Per distinct score: positives and negatives at it, and ``tp``/``fp`` counted from the highest score down.

    Rows are reduced to one per score before anything is ordered. The reduced table is written once, because ordering
    it reads it more than once and what comes before may be costly (the predictions of a model, for instance).
    """
    at_score = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives"))
    )
    return running_totals(
        durable(at_score),
        "threshold",
        {"tp": F.col("positives"), "fp": F.col("negatives")},
        by=by,
        descending=True,
        ranges=ranges,
        totals=True,
    )


def roc_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr)`` from :func:`threshold_counts`, starting at the origin with an infinite threshold."""
    points = counts.select(
        *by,
        F.col("threshold").cast("double").alias("threshold"),
        _ratio(F.col("fp"), F.col("total_fp")).alias("fpr"),
        _ratio(F.col("tp"), F.col("total_tp")).alias("tpr"),
    )
    return points.unionByName(_end_point(counts, by, fpr=0.0, tpr=0.0))


def _end_point(counts: DataFrame, by: Sequence[str], **values: float) -> DataFrame:
    """The point that no row is above, for each group that has rows."""
    groups = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return groups.select(
        *by, F.lit(float("inf")).alias("threshold"), *[F.lit(v).alias(name) for name, v in values.items()]
    )


def _precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp)


def pr_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, recall, precision)`` from :func:`threshold_counts`, ending at recall 0 with precision 1."""
    points = counts.select(
        *by,
        F.col("threshold").cast("double").alias("threshold"),
        _ratio(F.col("tp"), F.col("total_tp")).alias("recall"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
    )
    return points.unionByName(_end_point(counts, by, recall=0.0, precision=1.0))


def f_measure_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(threshold, f_measure)`` from :func:`threshold_counts`."""
    tp, fp, positives = F.col("tp"), F.col("fp"), F.col("total_tp")
    return counts.select(*by, "threshold", _ratio(2 * tp, tp + fp + positives).alias("f_measure"))


def best_f_threshold(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest F-measure and the highest threshold that attains it."""
    points = f_measure_points(counts, by).withColumn("_order", share_key("f_measure", "threshold"))
    return points.groupBy(*by).agg(F.max_by("threshold", "_order").alias("threshold"), F.max("f_measure").alias("f_measure"))


# --- areas -------------------------------------------------------------------------------------------------------
#
# Both areas are sums of trapezoids between neighbouring thresholds. The point before a threshold is the point at
# it less the rows at it, so no second look at the order is needed.


def _roc_area() -> Column:
    tp, pos, neg = (F.col(c).cast("double") for c in ("tp", "positives", "negatives"))
    strips = F.sum(neg * (2 * tp - pos) / 2)
    return _ratio(strips, F.max("total_tp").cast("double") * F.max("total_fp").cast("double"))


def _pr_area() -> Column:
    """The curve starts at recall 0 with the precision of its first point."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "positives", "negatives"))
    here = _precision(tp, fp)
    before = F.when(tp + fp == pos + neg, here).otherwise(_precision(tp - pos, fp - neg))
    return _ratio(F.sum(pos * (here + before) / 2), F.max("total_tp"))


def auroc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, from :func:`threshold_counts`."""
    return counts.groupBy(*by).agg(_roc_area().alias("auroc"))


def auprc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve, from :func:`threshold_counts`."""
    return counts.groupBy(*by).agg(_pr_area().alias("auprc"))


def area_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both areas in one aggregation."""
    return counts.groupBy(*by).agg(_roc_area().alias("auroc"), _pr_area().alias("auprc"))


def metric_rows(metrics: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Metric columns to ``(keep..., metric, value)`` rows."""
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return metrics.select(*keep, F.inline(F.array(*entries)))
