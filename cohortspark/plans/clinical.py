"""The clinical preset: early warning of infection in intensive care, from raw tables to compared models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import category_code, replace_sentinel
from cohortspark.operators.features import Rule
from cohortspark.operators.timeframe import index_dates
from cohortspark.plans import fixed_values as fixed
from cohortspark.plans.cohort import KEY_TYPE, build_cohort, clean_cultures, clean_prescriptions, clean_vitals
from cohortspark.plans.dictionaries import antibiotics
from cohortspark.plans.feature_sets import FeatureSpec, feature_table, feature_vectors
from cohortspark.sources.checkpoints import checkpoint_or_reload, durable
from cohortspark.sources.tables import read_csv_table, read_dictionary_ids, read_dictionary_text, read_typed_csv
from cohortspark.sources.vectors import feature_set_path, write_libsvm


def clinical_spec() -> FeatureSpec:
    """Nine vital signs, the quick organ-failure score, age and gender."""
    return FeatureSpec(
        entity="hadmID",
        item="itemID",
        value="value",
        time="chartTime",
        tie_break="value",
        items=fixed.VITAL_ITEMS,
        derived=fixed.DERIVED_ITEMS,
        rules=tuple(Rule(item, op, threshold) for item, op, threshold in fixed.SCORE_RULES),
        static={"age": lambda: replace_sentinel("age"), "gender": lambda: category_code("gender")},
        stay_order=("inTime", "icustayID"),
        index_time="indexDate",
    )


def record_steps(
    raw: Callable[[str], DataFrame], drugs: DataFrame, null_time: str = "epoch", vitals: DataFrame | None = None,
    key_type: str = KEY_TYPE,
) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """How each of the four record tables comes from the five raw ones (by name) and the cohort of stays."""
    return {
        "icustays": lambda done: build_cohort(raw("PATIENTS"), raw("ICUSTAYS"), key_type=key_type),
        "prescriptions": lambda done: clean_prescriptions(
            raw("PRESCRIPTIONS"), done["icustays"], drugs, null_time=null_time, key_type=key_type
        ),
        "microbiologyevents": lambda done: clean_cultures(
            raw("MICROBIOLOGYEVENTS"), done["icustays"], key_type=key_type
        ),
        "chartevents": lambda done: clean_vitals(
            raw("CHARTEVENTS"), done["icustays"], items=tuple(fixed.VITAL_ITEMS) if vitals is None else vitals,
            key_type=key_type,
        ),
    }


def clean_records(
    raw: dict[str, DataFrame], drugs: DataFrame, null_time: str = "epoch", key_type: str = KEY_TYPE
) -> dict[str, DataFrame]:
    """The four record tables; only the stays, which all the others are filtered by, are written in between."""
    records: dict[str, DataFrame] = {}
    for name, step in record_steps(raw.__getitem__, drugs, null_time, key_type=key_type).items():
        records[name] = durable(step(records)) if name == "icustays" else step(records)
    return records


def clinical_index(records: dict[str, DataFrame]) -> DataFrame:
    """``(hadmID, indexDate, label)``: drug orders are the first kind of event, cultures the second."""
    return index_dates(
        records["icustays"],
        records["prescriptions"],
        records["microbiologyevents"],
        entity="hadmID",
        out_time="outTime",
        a_time="startDate",
        b_time="chartDate",
        limit_b_then_a=fixed.CULTURE_THEN_DRUG_HOURS,
        limit_a_then_b=fixed.DRUG_THEN_CULTURE_HOURS,
        index_time="indexDate",
    )


def clinical_features(
    records: dict[str, DataFrame],
    pred_hours: int | Sequence[int] = fixed.PREDICTION_HOURS,
    obs_hours: int = fixed.OBSERVATION_HOURS,
    agg: str = "latest",
) -> DataFrame:
    """The feature table of the record tables."""
    return feature_table(
        clinical_index(records), records["chartevents"], records["icustays"], clinical_spec(), pred_hours, obs_hours, agg
    )


#: The columns of the raw files that are used, with their types; other columns of a file are left unread.
RAW_TYPES: dict[str, dict[str, str]] = {
    "PATIENTS": {"SUBJECT_ID": "INT", "GENDER": "STRING", "DOB": "TIMESTAMP", "DOD": "TIMESTAMP", "EXPIRE_FLAG": "INT"},
    "ICUSTAYS": {
        "SUBJECT_ID": "INT", "HADM_ID": "INT", "ICUSTAY_ID": "INT", "DBSOURCE": "STRING", "INTIME": "TIMESTAMP",
        "OUTTIME": "TIMESTAMP",
    },
    "PRESCRIPTIONS": {
        "SUBJECT_ID": "INT", "HADM_ID": "INT", "ICUSTAY_ID": "INT", "STARTDATE": "TIMESTAMP", "ENDDATE": "TIMESTAMP",
        "DRUG_TYPE": "STRING", "DRUG": "STRING", "DOSE_VAL_RX": "STRING", "DOSE_UNIT_RX": "STRING", "ROUTE": "STRING",
    },
    "MICROBIOLOGYEVENTS": {
        "SUBJECT_ID": "INT", "HADM_ID": "INT", "CHARTDATE": "TIMESTAMP", "CHARTTIME": "TIMESTAMP", "SPEC_ITEMID": "INT",
    },
    "CHARTEVENTS": {
        "SUBJECT_ID": "INT", "HADM_ID": "INT", "ICUSTAY_ID": "INT", "ITEMID": "INT", "CHARTTIME": "TIMESTAMP",
        "VALUENUM": "DOUBLE", "ERROR": "INT",
    },
}


def read_raw_table(spark: SparkSession, folder: str, name: str, schemas: dict[str, str] | None = None) -> DataFrame:
    """One of the raw files of a folder, also as a view of its name.

    Columns are found by the names in the header and have fixed types; lines that do not fit them are in the view
    ``<name>_rejected``. A schema of the caller's own is taken as it is, for all columns by their place.
    """
    path = f"{folder}/{name}.csv"
    if schemas is not None and name in schemas:
        return read_csv_table(spark, path, schemas[name])
    good, rejected = read_typed_csv(spark, path, RAW_TYPES[name])
    rejected.createOrReplaceTempView(f"{name}_rejected")
    return good


def run_clinical(
    spark: SparkSession,
    raw_folder: str,
    save_folder: str,
    *,
    reload: bool = False,
    pred_hours: int | Sequence[int] = fixed.PREDICTION_HOURS,
    obs_hours: int = fixed.OBSERVATION_HOURS,
    agg: str = "latest",
    schemas: dict[str, str] | None = None,
    drugs_path: str | None = None,
    vitals_path: str | None = None,
    null_time: str = "epoch",
) -> DataFrame:
    """Raw files to ``(hadmID, label, features)``, saving the record tables and the feature set below ``save_folder``.

    Saved record tables are used again unless ``reload`` is set. A list of ``pred_hours`` adds a column of that name
    and saves a feature set for each. ``vitals_path`` names a CSV dictionary of item ids to read instead of the fixed
    items; items outside the declared features have no column.
    """
    drugs = antibiotics(spark) if drugs_path is None else read_dictionary_text(spark, drugs_path)
    records = checkpoint_or_reload(
        spark,
        save_folder,
        record_steps(
            lambda name: read_raw_table(spark, raw_folder, name, schemas), drugs, null_time,
            None if vitals_path is None else read_dictionary_ids(spark, vitals_path),
        ),
        reload,
    )
    # Stored, so that saving and whatever the caller does with it compute it once.
    vectors = durable(feature_vectors(clinical_features(records, pred_hours, obs_hours, agg), clinical_spec()))
    for hours in [pred_hours] if isinstance(pred_hours, int) else sorted(set(pred_hours)):
        swept = vectors if isinstance(pred_hours, int) else vectors.where(F.col("pred_hours") == hours)
        write_libsvm(swept, feature_set_path(save_folder, obs_hours, hours, agg))
    return vectors
