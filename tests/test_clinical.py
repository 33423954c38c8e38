"""The clinical preset on hand-made raw files, end to end."""

from datetime import datetime

import pytest

from cohortspark.plans import fixed_values as fixed
from cohortspark.plans.clinical import (
    clean_records,
    clinical_features,
    clinical_index,
    clinical_spec,
    read_raw_table,
    run_clinical,
)
from cohortspark.plans.cohort import clean_prescriptions
from cohortspark.plans.dictionaries import antibiotics, diagnosis_dictionary, drug_dictionary, vital_dictionary
from cohortspark.plans.feature_sets import long_feature_table
from cohortspark.sources import feature_set_path, read_libsvm

FILES = {
    "PATIENTS": """SUBJECT_ID,GENDER,DOB,DOD,EXPIRE_FLAG
1,F,2070-01-01 00:00:00,,0
2,M,2040-06-15 00:00:00,2130-01-05 00:00:00,1
3,,2060-01-01 00:00:00,,0
4,F,2125-01-01 00:00:00,,0
5,M,1830-01-01 00:00:00,,0
6,M,2070-01-01 00:00:00,,0
""",
    "ICUSTAYS": """SUBJECT_ID,HADM_ID,ICUSTAY_ID,DBSOURCE,INTIME,OUTTIME
1,10,100,metavision,2130-01-01 00:00:00,2130-01-06 00:00:00
1,10,101,metavision,2130-01-07 00:00:00,2130-01-09 00:00:00
2,20,200,metavision,2130-01-01 00:00:00,2130-01-04 00:00:00
2,20,201,metavision,2130-01-04 06:00:00,2130-01-05 00:00:00
3,30,300,metavision,2130-01-01 00:00:00,2130-01-04 00:00:00
4,40,400,metavision,2130-01-01 00:00:00,2130-01-04 00:00:00
5,50,500,metavision,2130-01-01 00:00:00,2130-01-04 00:00:00
6,60,600,carevue,2130-01-01 00:00:00,2130-01-04 00:00:00
""",
    "PRESCRIPTIONS": """SUBJECT_ID,HADM_ID,ICUSTAY_ID,STARTDATE,ENDDATE,DRUG_TYPE,DRUG,DOSE_VAL_RX,DOSE_UNIT_RX,ROUTE
1,10,100,2130-01-03 00:00:00,2130-01-05 00:00:00,MAIN,Vancomycin,1,g,IV
1,10,100,2130-01-02 00:00:00,,ADDITIVE,Vancomycin,1,g,IV
1,10,100,2130-01-02 00:00:00,,MAIN,Aspirin,1,g,PO
1,10,100,2130-01-02 00:00:00,,MAIN,Vancomycin,1,g,LEFT EAR
1,10,,2130-01-02 00:00:00,,MAIN,Vancomycin,1,g,IV
2,20,200,2130-01-02 00:00:00,,MAIN,Cefepime,1,g,IV
3,30,300,2130-01-02 12:00:00,,MAIN,MEROPENEM,1,g,IV
3,30,300,,,MAIN,Meropenem,1,g,PO/NG
""",
    "MICROBIOLOGYEVENTS": """SUBJECT_ID,HADM_ID,CHARTDATE,CHARTTIME,SPEC_ITEMID
1,10,2130-01-02 00:00:00,2130-01-02 20:00:00,70012
1,10,2130-01-01 00:00:00,2130-01-01 01:00:00,70011
3,30,2130-01-02 00:00:00,,70012
6,60,2130-01-02 00:00:00,,70012
""",
    "CHARTEVENTS": """SUBJECT_ID,HADM_ID,ICUSTAY_ID,ITEMID,CHARTTIME,VALUENUM,ERROR
1,10,100,220045,2130-01-02 10:00:00,80,0
1,10,100,220045,2130-01-02 12:00:00,90,0
1,10,100,220045,2130-01-02 12:00:01,500,0
1,10,100,220179,2130-01-02 08:00:00,100,0
1,10,100,220210,2130-01-02 08:00:00,22,0
1,10,100,223900,2130-01-02 08:00:00,15,0
1,10,100,220277,2130-01-02 08:00:00,91,1
1,10,100,220277,2130-01-02 08:00:00,92,
1,10,100,220277,2130-01-02 08:00:00,,0
1,10,,220277,2130-01-02 08:00:00,93,0
1,10,100,999,2130-01-02 08:00:00,1,0
2,20,200,220045,2130-01-03 10:00:00,60,0
2,20,201,220045,2130-01-04 10:00:00,70,0
2,20,201,223900,2130-01-04 11:00:00,9,0
3,30,300,220179,2130-01-03 10:00:00,120,0
6,60,600,220179,2130-01-03 10:00:00,120,0
""",
}

SCHEMAS = {
    "PATIENTS": "SUBJECT_ID INT, GENDER STRING, DOB TIMESTAMP, DOD TIMESTAMP, EXPIRE_FLAG INT",
    "ICUSTAYS": "SUBJECT_ID INT, HADM_ID INT, ICUSTAY_ID INT, DBSOURCE STRING, INTIME TIMESTAMP, OUTTIME TIMESTAMP",
    "PRESCRIPTIONS": "SUBJECT_ID INT, HADM_ID INT, ICUSTAY_ID INT, STARTDATE TIMESTAMP, ENDDATE TIMESTAMP,"
    " DRUG_TYPE STRING, DRUG STRING, DOSE_VAL_RX STRING, DOSE_UNIT_RX STRING, ROUTE STRING",
    "MICROBIOLOGYEVENTS": "SUBJECT_ID INT, HADM_ID INT, CHARTDATE TIMESTAMP, CHARTTIME TIMESTAMP, SPEC_ITEMID INT",
    "CHARTEVENTS": "SUBJECT_ID INT, HADM_ID INT, ICUSTAY_ID INT, ITEMID INT, CHARTTIME TIMESTAMP, VALUENUM DOUBLE, ERROR INT",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def raw(spark, folder):
    return {name: read_raw_table(spark, folder, name, SCHEMAS) for name in FILES}


@pytest.fixture(scope="module")
def records(spark, raw):
    return clean_records(raw, antibiotics(spark))


def test_record_tables(records, rows):
    assert records["icustays"].dtypes == [
        ("subjectID", "int"), ("hadmID", "int"), ("icustayID", "int"), ("inTime", "timestamp"), ("outTime", "timestamp"),
        ("dod", "timestamp"), ("age", "double"), ("gender", "string"), ("expired", "int"),
    ]
    assert rows(records["icustays"], "icustayID") == [(100,), (101,), (200,), (201,), (300,)]
    assert records["prescriptions"].dtypes == [
        ("subjectID", "int"), ("hadmID", "int"), ("icustayID", "int"), ("startDate", "timestamp"),
        ("endDate", "timestamp"), ("drug", "string"), ("value", "string"), ("unit", "string"),
    ]
    starts = rows(records["prescriptions"], "hadmID", "startDate", "drug")
    assert (30, datetime(1970, 1, 1), "Meropenem") in starts and len(starts) == 4
    assert rows(records["microbiologyevents"]) == [
        (1, 10, datetime(2130, 1, 2, 20)), (3, 30, datetime(2130, 1, 2)),
    ]
    assert records["chartevents"].count() == 10
    assert records["chartevents"].dtypes[-2:] == [("chartTime", "timestamp"), ("value", "double")]


def test_index(records, rows):
    assert rows(clinical_index(records)) == sorted(
        [
            (10, datetime(2130, 1, 2, 20), 1),
            (20, datetime(2130, 1, 4), 0),
            (20, datetime(2130, 1, 5), 0),
            (30, datetime(2130, 1, 4), 0),
        ],
        key=repr,
    )


def test_missing_start_may_be_dropped_instead(spark, raw, records, rows):
    drugs = antibiotics(spark)
    kept = clean_prescriptions(raw["PRESCRIPTIONS"], records["icustays"], drugs, null_time="drop")
    assert rows(kept, "hadmID") == [(10,), (20,), (30,)]
    index = clinical_index({**records, "prescriptions": kept})
    assert (30, datetime(2130, 1, 2), 1) in rows(index)
    with pytest.raises(ValueError):
        clean_prescriptions(raw["PRESCRIPTIONS"], records["icustays"], drugs, null_time="keep")


def test_features(records, rows):
    wide = clinical_features(records)
    assert wide.columns == ["hadmID", "label", "score", "age", "gender", *fixed.VITAL_ITEMS.values()]
    # 220045 at the very end of the window counts, a second later does not; verbal 15 gives no point.
    assert rows(wide, "hadmID", "label", "score", "age", "gender", "heart_rate", "systolic_pressure", "gcs_verbal") == [
        (10, 1, 2.0, 60.0, 0.0, 90.0, 100.0, 15.0),
        (20, 0, 1.0, 89.55, 1.0, 70.0, None, 9.0),
        (30, 0, 0.0, 70.0, 1.0, None, 120.0, None),
    ]
    long = long_feature_table(wide, clinical_spec())
    assert (10, 1, 1, 2.0) in rows(long) and (30, 0, 3, 1.0) in rows(long)


def test_mean_features_count_overlapping_windows(records, rows):
    # The reading of 3 January 10:00 is in the window of the first out-time only, the next one in that of the second.
    assert rows(clinical_features(records, agg="mean"), "hadmID", "heart_rate")[1] == (20, 65.0)


def test_run_from_files(spark, folder, tmp_path, rows):
    save = str(tmp_path / "out")
    vectors = run_clinical(spark, folder, save, schemas=SCHEMAS)
    labels = rows(vectors, "hadmID", "label")
    assert vectors.columns == ["hadmID", "label", "features"]
    assert {len(r.features) for r in vectors.collect()} == {12}
    saved = read_libsvm(spark, feature_set_path(save, 24, 8))
    assert sorted(r.label for r in saved.collect()) == [0.0, 0.0, 1.0]
    # Saved tables are used again, even when the raw files are gone.
    again = run_clinical(spark, "/nowhere", save, pred_hours=4)
    assert rows(again, "hadmID") == [(10,), (20,), (30,)]
    inferred = run_clinical(spark, folder, save, reload=True)
    assert rows(inferred, "hadmID", "label") == labels


def test_fixed_values():
    assert len(fixed.ANTIBIOTICS) == 137 and len(set(fixed.ANTIBIOTICS)) == 134
    assert len(fixed.ANTIBIOTIC_PATTERNS) == 136 and len(set(fixed.ANTIBIOTIC_PATTERNS)) == 131
    assert list(clinical_spec().feature_items()) == [
        1, 2, 3, 220045, 220179, 220180, 220210, 220277, 220739, 223761, 223900, 223901,
    ]


def test_dictionaries(spark, rows):
    orders = spark.createDataFrame(
        [
            ("Vancomycin", "MAIN", "IV", "mg"), ("VANCOMYCIN", "ADDITIVE", "PO", "mg"), ("Imipenem", "MAIN", "IV", "mg"),
            ("Cefixime", "MAIN", "PO", "mg"), ("cefixime susp", "MAIN", "PO", "mg"), ("Neomycin cream", "MAIN", "IV", "mg"),
            ("Amikacin", "MAIN", "IV", None), ("Amikacin", "MAIN", None, "mg"), ("Amikacin", "MAIN", "IV", "Appl"),
            ("Amikacin", "BASE", "IV", "mg"), ("Amikacin", "MAIN", "TP", "mg"),
        ],
        "DRUG string, DRUG_TYPE string, ROUTE string, DOSE_UNIT_RX string",
    )
    assert [r.drug for r in drug_dictionary(orders).collect()] == ["cefixime susp", "vancomycin"]
    items = spark.createDataFrame(
        [
            (1, "Arterial BP", "metavision", "Respiratory"), (2, "bp", "metavision", "Respiratory"),
            (3, "GCS - Eye", "metavision", "Neurological"), (4, "Orthostatic BP", "metavision", "Respiratory"),
            (5, "RR > 30", "metavision", "Respiratory"), (6, "Heart Rate", "carevue", "Respiratory"),
            (7, "Heart Rate", "metavision", "Labs"), (8, "Heart Rate", "metavision", "Routine Vital Signs"),
        ],
        "itemid int, label string, dbsource string, category string",
    )
    assert rows(vital_dictionary(items), "itemid") == [(1,), (3,), (8,)]
    diagnoses = spark.createDataFrame(
        [
            ("a", "x", "Severe Sepsis"), ("b", "Septic shock", "Shock"), ("c", "x", "Puerperal sepsis"),
            ("d", "x", "Herpetic septicemia"), ("e", "Septic shock", None), ("f", "x", "Septicernia of newborn"),
        ],
        "icd9_code string, short_title string, long_title string",
    )
    assert rows(diagnosis_dictionary(diagnoses), "icd9_code") == [("a",), ("b",)]
