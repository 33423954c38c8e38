"""Train/test splits and cross-validation folds that depend on the key of a row only.

The same rows get the same split whatever the number of partitions and however often a task runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ordering import global_row_number

_HASH_SPACE = 1 << 32


def key_digest(key: str, seed: int) -> Column:
    """MD5 of seed and key, as 32 hexadecimal digits. A missing key has a digest of its own."""
    return F.md5(F.concat(F.lit(f"{seed}"), F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit(" NULL"))))


def key_bucket(key: str, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 drawn from the digest."""
    return F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("bigint")


def assign_split(df: DataFrame, key: str, train_share: float = 0.67, seed: int = 11, alias: str = "is_train") -> DataFrame:
    """Mark the rows of the train split with 1, the others with 0."""
    return df.withColumn(alias, (key_bucket(key, seed) < F.lit(int(train_share * _HASH_SPACE))).cast("int"))


def train_test_split(
    df: DataFrame, key: str | None, train_share: float = 0.67, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """Split by the hash of ``key``; without a key by Spark's random split."""
    if key is None:
        train, test = df.randomSplit([train_share, 1 - train_share], seed=seed)
        return train, test
    marked = assign_split(df, key, train_share, seed, "_train")
    return marked.where("_train = 1").drop("_train"), marked.where("_train = 0").drop("_train")


def kfold_assign(df: DataFrame, key: str, folds: int = 5, alias: str = "fold", ranges: int | None = None) -> DataFrame:
    """Contiguous folds 0..k-1 in the order of a unique key; the first ``n % k`` folds have one row more."""
    numbered = global_row_number(df, key, "_row", ranges)
    row, total = F.col("_row") - 1, F.col("total__row")
    small = F.floor(total / folds)
    larger = total % folds
    edge = larger * (small + 1)
    fold = F.when(row < edge, F.floor(row / (small + 1))).otherwise(
        larger + F.floor((row - edge) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(alias, fold.cast("int")).drop("_row", "total__row")


def stratified_kfold_assign(
    df: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 545510477, alias: str = "fold",
    digits: int = 3,
) -> DataFrame:
    """Folds 0..k-1, shuffled by the digest of the key and dealt out in turn within each label.

    A label may hold nearly all rows. Its rows are first cut into ``16**digits`` even ranges of the digest; counts
    per range say how many rows come before it, and only one range at a time is sorted.
    """
    columns = df.columns
    hashed = df.withColumns(
        {
            # A label that is missing is a stratum of its own; keys without NULL let the join use the window's shuffle.
            "_known": F.col(label).isNotNull(),
            "_stratum": F.coalesce(F.col(label).cast("string"), F.lit("")),
            "_digest": key_digest(key, seed),
        }
    ).withColumn("_part", F.substring("_digest", 1, digits))
    strata = ["_known", "_stratum"]
    before = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*strata, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*strata, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*strata, "_part").orderBy("_digest", key)
    ranked = hashed.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(starts, [*strata, "_part"], "inner").select(
        *columns, ((F.col("_start") + F.col("_rank") - 1) % folds).cast("int").alias(alias)
    )


def fold_sizes(df: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
