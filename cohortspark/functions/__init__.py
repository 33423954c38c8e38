"""Column expressions: built-in Spark functions only, no Python UDF."""

from cohortspark.functions.columns import (
    age_in_years,
    apply_threshold,
    category_code,
    first_present,
    in_observation_window,
    null_to_epoch,
    parse_number,
    replace_sentinel,
    seconds_before,
    to_time,
    vector_element,
    within_hours,
)
from cohortspark.functions.patterns import like_any, not_like_any

__all__ = [
    "age_in_years",
    "apply_threshold",
    "category_code",
    "first_present",
    "in_observation_window",
    "like_any",
    "not_like_any",
    "null_to_epoch",
    "parse_number",
    "replace_sentinel",
    "seconds_before",
    "to_time",
    "vector_element",
    "within_hours",
]
