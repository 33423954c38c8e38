"""Feature sets as libsvm files, and reports of metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.checkpoints import child_folders, read_parquet, write_parquet_checkpoint


def feature_set_path(base: str, obs_hours: int, pred_hours: int, agg: str = "latest") -> str:
    """Where the feature set of a pair of windows is kept."""
    prefix = {"latest": "features", "mean": "aggfeatures"}[agg]
    return f"{base}/svmoutput{obs_hours}/{prefix}{pred_hours}hour"


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Write label and vector, replacing what is there; other columns have no place in the format."""
    pairs = df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
    pairs.write.mode("overwrite").format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, n_features: int = 12) -> DataFrame:
    """All libsvm files of a folder as ``(label, features)``."""
    return spark.read.format("libsvm").option("numFeatures", n_features).load(path)


def write_feature_sets(df: DataFrame, path: str, window: str = "pred_hours", only_these: bool = False) -> None:
    """Write the feature sets of a sweep as one table with a partition per window.

    With ``only_these`` the windows that ``df`` has are replaced and the others stay as they are.
    """
    write_parquet_checkpoint(df, path, partition_by=window, only_these_partitions=only_these)


def read_feature_sets(spark: SparkSession, path: str, hours: int | None = None, window: str = "pred_hours") -> DataFrame:
    """The feature sets of a sweep, or one of them, of which only its partition is read."""
    df = read_parquet(spark, path)
    return df if hours is None else df.where(F.col(window) == hours)


def sweep_feature_sets(spark: SparkSession, folder: str, n_features: int = 12) -> list[tuple[int, DataFrame]]:
    """The feature sets in the sub-folders, each with its window: the last number in the name of the folder."""
    found = [(int(re.findall(r"\d+", path)[-1]), path) for path in child_folders(spark, folder)]
    return [(window, read_libsvm(spark, path, n_features)) for window, path in found]


def report_metrics(metrics: Sequence[DataFrame], path: str | None = None) -> DataFrame:
    """Stack ``(model, metric, value)`` tables; with a path, save them as parquet as well."""
    stacked = metrics[0]
    for other in metrics[1:]:
        stacked = stacked.unionByName(other)
    if path is not None:
        write_parquet_checkpoint(stacked, path)
    return stacked
