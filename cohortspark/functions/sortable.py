"""Order-preserving whole numbers.

``max_by`` and ``min_by`` stay in a hash aggregation only while what they order by fits a fixed-width field of the
aggregation buffer. A struct does not, so ordering by two columns would make Spark sort all rows of a map task. Here two
columns become one decimal of up to 38 digits that orders like the pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.columns import ColumnOrName, column

#: Infinity and NaN of a 64-bit floating-point number, as the whole number of its bits.
INFINITE, NOT_A_NUMBER = 0x7FF << 52, (0x7FF << 52) + (1 << 51)

#: More than there are numbers of 64 bits.
_RANKS = Decimal(10**20)

#: Times of the years 1 to 9999 lie between this and its negative, in microseconds.
_EARLIEST = -(10**17)


def sortable_double(c: ColumnOrName) -> Column:
    """A bigint that orders as the floating-point number does: the bits of its absolute value, with its sign.

    -0.0 is 0.0, NaN comes after infinity as everywhere in Spark, NULL stays NULL. All steps are exact: powers of two are,
    and so is a division by one that leaves the mantissa.
    """
    x = column(c).cast("double")
    size = F.abs(x)
    two = F.lit(2.0)
    # the logarithm may be off by one near powers of two
    guess = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022))
    guess = F.when((F.pow(two, guess) > size) & (guess > -1022), guess - 1).otherwise(guess)
    exponent = F.when((guess < 1023) & (F.pow(two, guess + 1) <= size), guess + 1).otherwise(guess)
    mantissa = ((size / F.pow(two, exponent)) * F.lit(float(1 << 52))).cast("bigint")  # below 2**52 if subnormal
    bits = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + mantissa
    bits = F.when(size == float("inf"), F.lit(INFINITE)).when(size == 0.0, F.lit(0).cast("bigint")).otherwise(bits)
    return F.when(F.isnan(x), F.lit(NOT_A_NUMBER)).when(x < 0, -bits).otherwise(bits)


def _rank(df: DataFrame, name: str) -> Column | None:
    """A decimal from 1 to below 10**20 that orders as the column does, 0 for NULL; None for types without one."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        number = c.cast("bigint")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        number = sortable_double(c)
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.BooleanType):
        number = c.cast("int").cast("bigint")
    else:
        return None
    return F.coalesce(number.cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)), F.lit(0).cast("decimal(21,0)"))


def pair_key(df: DataFrame, first: str, second: str) -> Column:
    """What orders rows by two columns, NULLs first: one decimal where the types allow it, else a struct.

    The first may be a date or a time of the years 1 to 9999, a whole number of at most 32 bits, or a share (a
    floating-point number from 0 to 1); the second any number, date or time.
    """
    rank = _rank(df, second)
    kind = df.schema[first].dataType
    c = F.col(first)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        place = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        place = F.unix_date(c).cast("bigint")
    elif isinstance(kind, T.IntegralType) and not isinstance(kind, T.LongType):
        place = c.cast("bigint")
    else:
        place = None
    if rank is None or place is None:
        return F.struct(first, second)
    place = F.coalesce(place, F.lit(_EARLIEST)).cast("decimal(18,0)").cast("decimal(38,0)")
    return (place * F.lit(_RANKS)).cast("decimal(38,0)") + rank


def share_key(share: ColumnOrName, second: ColumnOrName) -> Column:
    """What orders rows by a share (from 0 to 1) and then by a floating-point number, as one decimal."""
    place = sortable_double(share).cast("decimal(38,0)")  # at most the bits of 1.0, nineteen digits
    rank = sortable_double(second).cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1))
    return (place * F.lit(Decimal(2 * 10**19))).cast("decimal(38,0)") + rank


def order_key(df: DataFrame, names: Sequence[str]) -> Column:
    """What orders rows by several columns, NULLs first: a single number where their types allow it."""
    if len(names) == 1:
        rank = _rank(df, names[0])
        return F.struct(names[0]) if rank is None else rank
    return pair_key(df, *names) if len(names) == 2 else F.struct(*names)
