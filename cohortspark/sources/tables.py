"""Raw tables and dictionaries."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortspark.sources.checkpoints import durable

# Fixed value: the last word of a path, less a trailing ".csv", names the view.
_TABLE_NAME = re.compile(r"(\w+)(\.csv)?$")

_REJECTED = "_rejected"


def infer_table_name(path: str) -> str:
    """``data/PATIENTS.csv`` gives ``PATIENTS``; a path that ends in no word is returned whole."""
    found = _TABLE_NAME.search(path)
    return found.group(1) if found else path


def read_csv_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, view: str | None = None, sep: str = ","
) -> DataFrame:
    """Read a CSV file with a header line and register it as a temporary view, named after the file by default.

    With a schema the file is read once and only where columns are used; without one Spark reads all of it an
    additional time to infer the types.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    df.createOrReplaceTempView(view or infer_table_name(path))
    return df


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names in the first line of a CSV file, or of a folder's files; only that line is read."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_typed_csv(
    spark: SparkSession, path: str, types: Mapping[str, str], view: str | None = None, sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a CSV file with a header line, told apart in one pass over the file.

    ``types`` gives the types of the columns that are wanted, by name, whatever their place in the file; the others are
    text and only read when they are used. A line with too few or too many fields, or with a value that is not of its
    column's type, is rejected: its text is in the column ``line`` of the second table, and its wanted columns are missing
    from the first. Good rows are registered as a view. Columns that the file lacks raise an error.

    Both tables are parts of one stored scan, so whatever reads them later does not parse the file again.
    """
    names = header_names(spark, path, sep)
    if missing := [name for name in types if name not in names]:
        raise ValueError(f"{path} has no columns {missing}")
    fields = ", ".join(f"`{name}` {types.get(name, 'STRING')}" for name in names)
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", True)
    reader = reader.option("columnPruning", False)  # a pruned parser does not count fields
    scan = reader.option("columnNameOfCorruptRecord", _REJECTED).schema(f"{fields}, {_REJECTED} STRING").csv(path)
    stored = durable(scan.select(*types, _REJECTED))
    good = stored.where(F.col(_REJECTED).isNull()).select(*types)
    good.createOrReplaceTempView(view or infer_table_name(path))
    return good, stored.where(F.col(_REJECTED).isNotNull()).select(F.col(_REJECTED).alias("line"))


def read_dictionary_text(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line to distinct lower-case entries in a column ``value``."""
    return distinct_lower(spark.read.text(path), "value")


def distinct_lower(df: DataFrame, column: str, alias: str = "value") -> DataFrame:
    return df.select(F.lower(F.col(column)).alias(alias)).distinct()


def read_dictionary_ids(
    spark: SparkSession, path: str, column: str = "itemid", schema: str = "itemid INT, label STRING"
) -> DataFrame:
    """The distinct ids of a dictionary file."""
    return read_csv_table(spark, path, schema).select(column).distinct()
