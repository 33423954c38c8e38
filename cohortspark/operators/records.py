"""Projection of raw rows to records with fixed names and types, and scaling of numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_record(df: DataFrame, fields: Mapping[str, tuple[str | Column, str]]) -> DataFrame:
    """``fields`` maps the name of a record field to its source (a column or expression) and its type."""
    return df.select(
        *[
            (F.col(source) if isinstance(source, str) else source).cast(type_).alias(name)
            for name, (source, type_) in fields.items()
        ]
    )


def scale_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide columns by their sample standard deviation; a constant column becomes 0.

    One aggregation brings the deviations to the driver, a number per column; the division then is a projection.
    """
    deviations = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).head().asDict()
    scaled = {c: F.col(c) / F.lit(d) if d else F.when(F.col(c).isNotNull(), F.lit(0.0)) for c, d in deviations.items()}
    return df.withColumns(scaled)
