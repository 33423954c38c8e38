"""Sparse feature vectors over as many items as the data has.

The dictionary of items is a stored table: each distinct item with its position in ascending order. Positions come from
ranges of the items and the counts of these, so no task sees all items and none comes to the driver. Values meet their
positions in a join, and one aggregation collects a key's pairs of position and value; there is no expression per item, and
a row is as long as its key has values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortspark.operators.joins import spread_join
from cohortspark.operators.ordering import global_row_number
from cohortspark.sources.checkpoints import durable, shared_folder, write_parquet_checkpoint


def item_positions(long: DataFrame, item: str, ranges: int | None = None) -> DataFrame:
    """(item, position, width): every distinct item with its place from 0 in ascending order, and how many there are.

    Rows without an item have no place. Stored, as layouts read it more than once.
    """
    distinct = durable(long.where(F.col(item).isNotNull()).select(item).distinct())
    numbered = global_row_number(distinct, item, "_row", ranges)
    return durable(numbered.select(item, (F.col("_row") - 1).cast("int").alias("position"), F.col("total__row").cast("int").alias("width")))


def sparse_features(
    long: DataFrame, keys: Sequence[str], item: str, value: str, positions: DataFrame, salts: int | None = None
) -> DataFrame:
    """(keys, width, indices, values): a row per key with the positions of its items in ascending order and their values.

    Long rows hold one value per key and item. Missing values, and items without a position, are left out; a key without any
    value left has no row.
    """
    known = long.where(F.col(value).isNotNull()).select(*keys, item, F.col(value).cast("double").alias("_value"))
    placed = spread_join(known, positions, item, "inner", salts, list(keys))
    pairs = F.sort_array(F.collect_list(F.struct("position", F.col("_value").alias("value")))).alias("_pairs")
    held = placed.groupBy(*keys).agg(F.max("width").alias("width"), pairs)
    return held.select(*keys, "width", F.col("_pairs.position").alias("indices"), F.col("_pairs.value").alias("values"))


def sparse_vectors(features: DataFrame, keep: Sequence[str], output: str = "features") -> DataFrame:
    """The rows of :func:`sparse_features` as (keep..., vector).

    They are written in the layout that ML vectors have in files and read back as vectors, so no Python code builds them.
    """
    spark = features.sparkSession
    kind = F.lit(0).cast("tinyint").alias("type")  # sparse
    vector = F.struct(kind, F.col("width").alias("size"), "indices", "values").alias(output)
    path = shared_folder(spark)
    write_parquet_checkpoint(features.select(*keep, vector), path)
    schema = StructType([*[features.schema[k] for k in keep], StructField(output, VectorUDT())])
    return spark.read.schema(schema).parquet(path)
