"""Dictionaries found by pattern: drugs, vital signs and diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.patterns import like_any
from cohortspark.operators.filters import (
    exclude_any_pattern,
    filter_equals,
    filter_in_list,
    match_any_pattern,
    not_equal,
    not_in_literals,
)
from cohortspark.plans import fixed_values as fixed
from cohortspark.sources.tables import distinct_lower


def antibiotics(spark: SparkSession) -> DataFrame:
    """The fixed list of antibiotic names as a dictionary."""
    names = dict.fromkeys(name.lower() for name in fixed.ANTIBIOTICS)
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("value"))


def drug_dictionary(prescriptions: DataFrame) -> DataFrame:
    """Distinct lower-case names of systemically given antibiotics, in order of name."""
    kept = filter_in_list(prescriptions, "DRUG_TYPE", fixed.DICTIONARY_DRUG_TYPES)
    kept = filter_in_list(kept, "ROUTE", fixed.ROUTES)
    kept = not_equal(kept, "DOSE_UNIT_RX", *fixed.EXCLUDED_DOSE_UNITS)
    kept = exclude_any_pattern(kept, "ROUTE", fixed.EXCLUDED_ROUTE_PATTERNS)
    names = distinct_lower(kept, "DRUG", "drug")
    names = match_any_pattern(names, "drug", fixed.ANTIBIOTIC_PATTERNS, lower=False)
    names = exclude_any_pattern(names, "drug", fixed.EXCLUDED_DRUG_PATTERNS, lower=False)
    return names.orderBy("drug")


def vital_dictionary(items: DataFrame) -> DataFrame:
    """Items that record a vital sign."""
    kept = filter_in_list(filter_equals(items, dbsource=fixed.DATA_SOURCE), "category", fixed.VITAL_CATEGORIES)
    kept = kept.where(
        like_any("label", fixed.VITAL_LABEL_PATTERNS) | like_any("label", fixed.VITAL_RAW_LABEL_PATTERNS, lower=False)
    )
    return exclude_any_pattern(kept, "label", fixed.EXCLUDED_VITAL_PATTERNS).select("itemid", "label")


def diagnosis_dictionary(diagnoses: DataFrame) -> DataFrame:
    """Codes of the diagnoses that stand for the condition in adults."""
    kept = diagnoses.where(
        like_any("long_title", fixed.DIAGNOSIS_LONG_PATTERNS) | like_any("short_title", fixed.DIAGNOSIS_SHORT_PATTERNS)
    )
    kept = exclude_any_pattern(kept, "long_title", fixed.EXCLUDED_DIAGNOSIS_PATTERNS)
    return not_in_literals(kept, "long_title", fixed.EXCLUDED_DIAGNOSES).select(
        "icd9_code", "short_title", "long_title"
    )
