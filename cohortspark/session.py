"""Session settings that the jobs here rely on; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times without a zone are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # Partition counts follow the size of the data at run time, and oversized join partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that the caller owns."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
