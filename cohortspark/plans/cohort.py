"""The four cleaned record tables: stays, drug orders, cultures and vital signs.

Each function takes raw tables and returns one with a fixed schema. Filters stand before joins and columns are
named from the start, so both reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import age_in_years, first_present, null_to_epoch
from cohortspark.operators.filters import (
    filter_age_band,
    filter_equals,
    filter_in_dictionary,
    filter_in_list,
    filter_not_null,
)
from cohortspark.operators.joins import join_demographics, semi_join
from cohortspark.operators.records import project_record
from cohortspark.plans import fixed_values as fixed

# Type of ids in records unless another one is asked for (``bigint`` where ids outgrow it).
KEY_TYPE = "int"


def person_fields(key_type: str) -> dict[str, tuple[str, str]]:
    """Fields that all records share."""
    return {"subjectID": ("SUBJECT_ID", key_type), "hadmID": ("HADM_ID", key_type)}


def stay_fields(key_type: str) -> dict[str, tuple[str, str]]:
    return {**person_fields(key_type), "icustayID": ("ICUSTAY_ID", key_type)}


def build_cohort(
    patients: DataFrame,
    stays: DataFrame,
    *,
    source: str = fixed.DATA_SOURCE,
    low_age: float = 15.0,
    high_age: float = 90.0,
    salts: int | None = None,
    key_type: str = KEY_TYPE,
) -> DataFrame:
    """Stays of one source whose person is within the age band on the day of admission."""
    kept = filter_equals(
        stays.select("ICUSTAY_ID", "SUBJECT_ID", "HADM_ID", "INTIME", "OUTTIME", "DBSOURCE"), DBSOURCE=source
    )
    persons = patients.select("SUBJECT_ID", "DOB", "DOD", "GENDER", "EXPIRE_FLAG")
    joined = filter_age_band(join_demographics(kept, persons, salts=salts), "INTIME", "DOB", low_age, high_age)
    return project_record(
        joined,
        {
            **stay_fields(key_type),
            "inTime": ("INTIME", "timestamp"),
            "outTime": ("OUTTIME", "timestamp"),
            "dod": ("DOD", "timestamp"),
            "age": (age_in_years("INTIME", "DOB"), "double"),
            "gender": ("GENDER", "string"),
            "expired": ("EXPIRE_FLAG", "int"),
        },
    )


def clean_prescriptions(
    prescriptions: DataFrame,
    cohort: DataFrame,
    drugs: DataFrame,
    *,
    drug_types: Sequence[str] = fixed.PIPELINE_DRUG_TYPES,
    routes: Sequence[str] = fixed.ROUTES,
    null_time: str = "epoch",
    salts: int | None = None,
    key_type: str = KEY_TYPE,
) -> DataFrame:
    """Orders of listed drugs by listed routes within cohort stays.

    A missing start or end becomes the epoch, which then is the earliest event of its admission;
    ``null_time='drop'`` leaves orders without a start out instead and keeps a missing end NULL.
    """
    if null_time not in ("epoch", "drop"):
        raise ValueError(f"null_time is epoch or drop, not {null_time}")
    listed = filter_in_list(filter_in_list(prescriptions, "DRUG_TYPE", drug_types), "ROUTE", routes)
    listed = filter_in_dictionary(listed, "DRUG", drugs, salts=salts)
    kept = semi_join(listed, cohort, "ICUSTAY_ID", "icustayID", salts)
    if null_time == "epoch":
        start, end = null_to_epoch("STARTDATE"), null_to_epoch("ENDDATE")
    else:
        kept = filter_not_null(kept, "STARTDATE")
        start, end = F.col("STARTDATE"), F.col("ENDDATE")
    return project_record(
        kept,
        {
            **stay_fields(key_type),
            "startDate": (start, "timestamp"),
            "endDate": (end, "timestamp"),
            "drug": ("DRUG", "string"),
            "value": ("DOSE_VAL_RX", "string"),
            "unit": ("DOSE_UNIT_RX", "string"),
        },
    )


def clean_cultures(
    microbiology: DataFrame, cohort: DataFrame, *, specimen: int = fixed.BLOOD_CULTURE_SPECIMEN, salts: int | None = None,
    key_type: str = KEY_TYPE,
) -> DataFrame:
    """Cultures of one specimen from persons of the cohort, at their time or else on their date."""
    kept = semi_join(filter_equals(microbiology, SPEC_ITEMID=specimen), cohort, "SUBJECT_ID", "subjectID", salts)
    return project_record(kept, {**person_fields(key_type), "chartDate": (first_present("CHARTTIME", "CHARTDATE"), "timestamp")})


def clean_vitals(
    chart: DataFrame, cohort: DataFrame, *, items: Sequence[int] | DataFrame = tuple(fixed.VITAL_ITEMS),
    salts: int | None = None, key_type: str = KEY_TYPE,
) -> DataFrame:
    """Numeric readings of the listed items, free of errors, within cohort stays.

    ``items`` are item codes, or a dictionary with a column ``itemid``.
    """
    readings = chart.select("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "ITEMID", "CHARTTIME", "VALUENUM", "ERROR")
    readings = filter_not_null(filter_equals(readings, ERROR=0), "VALUENUM")
    if isinstance(items, DataFrame):
        readings = semi_join(readings, items, "ITEMID", "itemid", salts)
    else:
        readings = filter_in_list(readings, "ITEMID", items)
    return project_record(
        semi_join(readings, cohort, "ICUSTAY_ID", "icustayID", salts),
        {
            **stay_fields(key_type),
            "itemID": ("ITEMID", "int"),
            "chartTime": ("CHARTTIME", "timestamp"),
            "value": ("VALUENUM", "double"),
        },
    )
