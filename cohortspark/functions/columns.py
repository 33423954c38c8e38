"""Scalar expressions on times, ages, codes and scores.

All of them are built-in Spark expressions, so they stay inside whole-stage code generation and are visible to
the optimizer. Arguments may be column names or Columns.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Length of a year in days used for ages. The upper age limit of the clinical cohort is tested with the second
# value; the two differ in the order of two digits and both are part of the expected results.
YEAR_DAYS = Decimal("365.242")
UPPER_LIMIT_YEAR_DAYS = Decimal("365.424")


def column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_time(c: ColumnOrName, fmt: str | None = None) -> Column:
    """Parse a timestamp; text that is not one becomes NULL also in ANSI mode."""
    return F.try_to_timestamp(column(c)) if fmt is None else F.try_to_timestamp(column(c), F.lit(fmt))


def age_in_years(at: ColumnOrName, birth: ColumnOrName, year_days: Decimal = YEAR_DAYS, digits: int = 2) -> Column:
    """Calendar days between two dates as years, in decimal arithmetic, rounded half up, returned as double."""
    days = F.datediff(column(at), column(birth))
    return F.round(days / F.lit(year_days), digits).cast("double")


def _millis(c: ColumnOrName) -> Column:
    return F.unix_millis(column(c).cast("timestamp"))


def within_hours(later: ColumnOrName, earlier: ColumnOrName, hours: float) -> Column:
    """True when ``later`` is at most ``hours`` after ``earlier``; inclusive, to the millisecond."""
    return (_millis(later) - _millis(earlier)) <= F.lit(round(hours * 3_600_000)).cast("bigint")


def seconds_before(index_time: ColumnOrName, time: ColumnOrName) -> Column:
    """Whole seconds by which ``time`` precedes ``index_time``."""
    return F.unix_timestamp(column(index_time)) - F.unix_timestamp(column(time))


def in_observation_window(
    index_time: ColumnOrName, time: ColumnOrName, pred_hours: int, obs_hours: int
) -> Column:
    """True when ``time`` lies in the ``obs_hours`` that end ``pred_hours`` before the index; both ends inclusive."""
    return seconds_before(index_time, time).between(pred_hours * 3600, (pred_hours + obs_hours) * 3600)


def first_present(*candidates: ColumnOrName) -> Column:
    """First of the columns that is not NULL."""
    return F.coalesce(*[column(c) for c in candidates])


def null_to_epoch(c: ColumnOrName) -> Column:
    """A timestamp column with NULL replaced by the Unix epoch."""
    return F.coalesce(column(c).cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def parse_number(c: ColumnOrName) -> Column:
    """Text with thousands separators as double; NaN when it is missing or no number."""
    return F.coalesce(F.replace(column(c), F.lit(","), F.lit("")).try_cast("double"), F.lit(float("nan")))


def category_code(c: ColumnOrName, match: str = "F", hit: float = 0.0, other: float = 1.0) -> Column:
    """``hit`` for one category and ``other`` for everything else, NULL included."""
    return F.when(column(c) == match, F.lit(hit)).otherwise(F.lit(other))


def replace_sentinel(c: ColumnOrName, sentinel: float = 300.0, value: float = 90.0) -> Column:
    """Exchange a marker value (an obfuscated age, for instance) for a usable one."""
    return F.when(column(c) == F.lit(sentinel), F.lit(value)).otherwise(column(c))


def apply_threshold(probability: ColumnOrName, threshold: float = 0.5) -> Column:
    """1 when the probability is strictly above the threshold, else 0."""
    return (column(probability) > F.lit(threshold)).cast("int")


def vector_element(c: ColumnOrName, position: int = 1) -> Column:
    """One element of an ML vector column."""
    return vector_to_array(column(c))[position]
