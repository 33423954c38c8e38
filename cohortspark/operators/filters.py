"""Row filters: equality, lists, dictionaries, patterns and age bands.

SQL semantics for NULL hold throughout: a predicate that is not true drops the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import UPPER_LIMIT_YEAR_DAYS, YEAR_DAYS, ColumnOrName, age_in_years, column
from cohortspark.functions.patterns import like_any, not_like_any
from cohortspark.operators.joins import semi_join_value


def filter_equals(df: DataFrame, **values: Any) -> DataFrame:
    """Keep rows in which every named column has the given value."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def not_equal(df: DataFrame, c: str, *values: Any) -> DataFrame:
    """Keep rows whose value differs from all given ones; NULL is dropped."""
    for value in values:
        df = df.where(F.col(c) != F.lit(value))
    return df


def filter_not_null(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.where(F.col(name).isNotNull())
    return df


def filter_in_list(df: DataFrame, c: str, values: Sequence[Any]) -> DataFrame:
    """Keep rows whose value is in a short fixed list."""
    return df.where(F.col(c).isin(*values))


def not_in_literals(df: DataFrame, c: ColumnOrName, values: Sequence[Any], lower: bool = True) -> DataFrame:
    """Keep rows whose (lower-cased) value is in none of the literals; NULL is dropped."""
    text = F.lower(column(c)) if lower else column(c)
    return df.where(~text.isin(*values))


def filter_in_dictionary(
    df: DataFrame, c: str, dictionary: DataFrame, entry: str = "value", lower: bool = True, salts: int | None = None
) -> DataFrame:
    """Keep rows whose (lower-cased) value exactly equals an entry of the dictionary."""
    return semi_join_value(df, F.lower(F.col(c)) if lower else F.col(c), dictionary, entry, salts)


def match_any_pattern(df: DataFrame, c: str, patterns: Sequence[str], lower: bool = True) -> DataFrame:
    return df.where(like_any(c, patterns, lower))


def exclude_any_pattern(df: DataFrame, c: str, patterns: Sequence[str], lower: bool = True) -> DataFrame:
    return df.where(not_like_any(c, patterns, lower))


def filter_age_band(
    df: DataFrame,
    at: ColumnOrName,
    birth: ColumnOrName,
    low: float = 15.0,
    high: float = 90.0,
    low_year_days: Decimal = YEAR_DAYS,
    high_year_days: Decimal = UPPER_LIMIT_YEAR_DAYS,
) -> DataFrame:
    """Keep ages from ``low`` (inclusive) to ``high`` (exclusive), each limit with its own length of a year."""
    return df.where(
        (age_in_years(at, birth, low_year_days) >= low) & (age_in_years(at, birth, high_year_days) < high)
    )
