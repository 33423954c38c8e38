"""Running totals and row numbers over a global order, without sorting everything in one task.

The order column is cut into ranges of about equal size at approximate quantiles. Totals of the ranges (one row
each) give every range its starting point, and the running totals inside a range need only that range's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from cohortspark.sources.checkpoints import durable

_RANGE = "_range"


def order_ranges(df: DataFrame, order: str, ranges: int | None = None, alias: str = _RANGE) -> DataFrame:
    """Add the number of the range of ``order`` a row is in, ascending.

    The quantiles are found by one job that brings ``ranges`` numbers to the driver; from then on they are
    constants, so that a task that runs again puts its rows into the same range. Equal values share a range.
    Text has no quantiles: Spark deals it out by ranges, and the rows are stored with the number of theirs.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(df.schema[order].dataType, StringType | BinaryType):
        return durable(df.repartitionByRange(ranges, F.col(order).asc()).withColumn(alias, F.spark_partition_id()))
    numeric = df.withColumn("_order", F.col(order).cast("double"))
    cuts: list[float] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = numeric.select("_order").approxQuantile("_order", shares, 1.0 / (4 * ranges))
        cuts = sorted({c for c in found if isfinite(c)})
    if not cuts:
        return df.withColumn(alias, F.lit(0))
    cutter = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_order", outputCol=alias, handleInvalid="keep")
    # NaN gets a range after all numbers, NULL one before them: where Spark sorts them, too.
    numbered = cutter.transform(numeric)
    return numbered.withColumn(alias, F.coalesce(F.col(alias).cast("int"), F.lit(-1))).drop("_order")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add running sums in the order of one numeric, date, time or text column, unique within ``by``.

    ``sums`` maps the name of a running sum to the expression summed. With ``totals``, columns ``total_<name>``
    carry the sum over all rows.
    """
    ranged = order_ranges(df, order, ranges)

    def sort_key(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    # One row per range (and group): the sums of all ranges that come before it.
    per_range = ranged.groupBy(*by, _RANGE).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(sort_key(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    starts = per_range.select(
        *by,
        _RANGE,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(everything).alias(f"total_{n}") for n in sums],
    )

    inside = (
        Window.partitionBy(*by, _RANGE).orderBy(sort_key(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    columns = df.columns
    partial = ranged.select(*columns, _RANGE, *[F.sum(c).over(inside).alias(f"_inside_{n}") for n, c in sums.items()])
    # Without groups there are no more rows than ranges; with groups the planner decides by size.
    joined = partial.join(starts if by else F.broadcast(starts), [*by, _RANGE], "inner")
    return joined.select(
        *columns,
        *[(F.col(f"_inside_{n}") + F.col(f"_start_{n}")).alias(n) for n in sums],
        *[F.col(f"total_{n}") for n in sums if totals],
    )


def global_row_number(df: DataFrame, order: str, alias: str = "row_number", ranges: int | None = None) -> DataFrame:
    """Number rows from 1 in the order of a unique column, with the number of rows as ``total_<alias>``."""
    return running_totals(df, order, {alias: F.lit(1)}, ranges=ranges, totals=True)
