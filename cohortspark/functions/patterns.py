"""LIKE predicates over lists of patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions.columns import ColumnOrName, column


def _combine(parts: Sequence[Column], op: Callable[[Column, Column], Column]) -> Column:
    """Join predicates pairwise, so that long lists make a shallow expression tree."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return op(_combine(parts[:half], op), _combine(parts[half:], op))


def like_any(c: ColumnOrName, patterns: Sequence[str], lower: bool = True) -> Column:
    """``c LIKE p1 OR c LIKE p2 ...``. Plain ``%word%`` patterns are planned as substring searches.

    With ``lower`` the column is lower-cased first; the patterns are taken as they are, so one with a capital
    letter then never matches. A NULL column gives NULL, which a filter drops.
    """
    distinct = list(dict.fromkeys(patterns))
    if not distinct:
        return F.lit(False)

    def matches(text: Column) -> Column:
        return _combine([text.like(p) for p in distinct], lambda a, b: a | b)

    # An array of one element, so that the text is lower-cased once and not for each pattern.
    return F.exists(F.array(F.lower(column(c))), matches) if lower else matches(column(c))


def not_like_any(c: ColumnOrName, patterns: Sequence[str], lower: bool = True) -> Column:
    """``c NOT LIKE p1 AND c NOT LIKE p2 ...``; NULL stays NULL and is dropped by a filter."""
    return ~like_any(c, patterns, lower)
