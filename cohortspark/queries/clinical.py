"""The clinical preset over raw tables that Spark derives from ``events``, ``customer``, ``part`` and ``orders``.

Users become patients, fifteen days of a user an admission and five days a stay, sign-ups drug orders, errors cultures
and the other events chart readings; ids of persons, admissions and stays are different numbers. The number in ``props`` and the value decide on codes, units and gaps, so that every filter
has rows to keep and rows to drop. The same derivation is written as SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.timeframe import label_counts, table_counts
from cohortspark.plans import dictionaries
from cohortspark.plans import fixed_values as fixed
from cohortspark.plans.clinical import clean_records, clinical_features as features, clinical_index as index_of
from cohortspark.plans.clinical import clinical_spec
from cohortspark.plans.feature_sets import long_feature_table
from cohortspark.queries.registry import query, table

# CASE expressions that Spark and the SQL used for comparison both understand.
DRUG = """CASE WHEN value < 20 THEN 'Vancomycin' WHEN value < 40 THEN 'CefePIME' WHEN value < 55 THEN 'Ciprofloxacin IV'
 WHEN value < 70 THEN 'Meropenem' WHEN value < 85 THEN 'Erythromycin' WHEN value < 110 THEN 'Neomycin Cream'
 WHEN value < 120 THEN 'Imipenem' WHEN value < 150 THEN 'Amoxicillin gel' ELSE 'Aspirin' END"""
DRUG_TYPE = "CASE WHEN k < 85 THEN 'MAIN' WHEN k < 95 THEN 'ADDITIVE' ELSE 'BASE' END"
ROUTE = "CASE WHEN k < 60 THEN 'IV' WHEN k < 80 THEN 'PO' WHEN k < 90 THEN 'PO/NG' WHEN k < 95 THEN 'LEFT EAR' END"
UNIT = "CASE WHEN value < 3 THEN NULL WHEN k < 50 THEN 'mg' WHEN k < 55 THEN 'Appl' WHEN k < 58 THEN 'DROP' ELSE 'mL' END"
ITEM = """CASE WHEN k < 11 THEN 220045 WHEN k < 22 THEN 220179 WHEN k < 33 THEN 220180 WHEN k < 44 THEN 220210
 WHEN k < 55 THEN 220277 WHEN k < 66 THEN 220739 WHEN k < 77 THEN 223761 WHEN k < 88 THEN 223900 WHEN k < 98 THEN 223901
 ELSE 220050 END"""
READING = "CASE WHEN value <= 250 THEN value END"
ERROR = "CASE WHEN value < 2 THEN 1 WHEN value >= 3 THEN 0 END"
GENDER = "CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'F' WHEN c_mktsegment <> 'MACHINERY' THEN 'M' END"
SPECIMEN = "CASE WHEN k < 85 THEN 70012 ELSE 70011 END"
VITAL_LABEL = """CASE WHEN p_size < 8 THEN 'Arterial Blood Pressure mean' WHEN p_size < 14 THEN 'ART BP Systolic'
 WHEN p_size < 20 THEN 'Orthostatic HR Heart Rate' WHEN p_size < 26 THEN 'Respiratory Rate (Total)'
 WHEN p_size < 30 THEN 'Temperature Celsius' WHEN p_size < 34 THEN 'GCS - Eye Opening' WHEN p_size < 38 THEN 'RR > 30 Heart Rate'
 WHEN p_size < 42 THEN 'bp cuff' ELSE 'Weight' END"""
VITAL_CATEGORY = """CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'Routine Vital Signs' WHEN p_type = 'SMALL' THEN 'Respiratory'
 WHEN p_type = 'MEDIUM' THEN 'Neurological' ELSE 'Labs' END"""
VITAL_SOURCE = "CASE WHEN p_retailprice < 920 THEN 'carevue' ELSE 'metavision' END"
LONG_TITLE = """CASE WHEN p_size < 8 THEN 'Sepsis of ' || p_name WHEN p_size < 12 THEN 'Puerperal sepsis, ' || p_name
 WHEN p_size < 16 THEN 'Herpetic septicemia' WHEN p_size < 20 THEN 'Streptococcal septicemia' WHEN p_size < 24 THEN 'Shock, ' || p_name
 WHEN p_size < 28 THEN 'Septicemia of newborn' WHEN p_size >= 34 THEN 'Fracture, ' || p_name END"""
SHORT_TITLE = "CASE WHEN p_size >= 20 AND p_size < 24 THEN 'Septic Shock' ELSE p_type END"


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    start = F.lit("2024-01-01").cast("date")
    day = F.datediff("ts", start)
    admission, stay = F.floor(day / 15).cast("bigint"), F.floor(day / 5).cast("bigint")
    of_user = [F.col("user_id").alias("SUBJECT_ID"), (F.col("user_id") * 3 + admission + 1_000_000).alias("HADM_ID")]
    keys = [*of_user, (F.col("user_id") * 10 + stay + 2_000_000).alias("ICUSTAY_ID")]

    def of_kind(*kinds: str) -> DataFrame:
        return events.where(F.col("event_type").isin(*kinds))

    customers = table(spark, folder, "customer")
    died = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("2024-06-01").cast("timestamp"))
    return {
        "PATIENTS": customers.select(
            F.col("c_custkey").alias("SUBJECT_ID"),
            F.date_sub(F.lit("2009-06-01").cast("date"), F.floor(F.col("c_acctbal") * 3).cast("int")).alias("DOB"),
            died.alias("DOD"),
            F.expr(GENDER).alias("GENDER"),
            died.isNotNull().cast("int").alias("EXPIRE_FLAG"),
        ),
        "ICUSTAYS": events.groupBy(*keys)
        .agg(F.min("ts").alias("INTIME"), F.max("ts").alias("OUTTIME"), F.max("value").alias("_peak"))
        .withColumn("DBSOURCE", F.when(F.col("_peak") > 120, "metavision").otherwise("carevue"))
        .drop("_peak"),
        "PRESCRIPTIONS": of_kind("signup").select(
            *keys,
            F.when(F.col("k") < 97, F.col("ts")).alias("STARTDATE"),
            F.when(F.col("k") < 50, F.col("ts")).alias("ENDDATE"),
            F.expr(DRUG_TYPE).alias("DRUG_TYPE"),
            F.expr(DRUG).alias("DRUG"),
            F.expr(ROUTE).alias("ROUTE"),
            F.col("k").cast("string").alias("DOSE_VAL_RX"),
            F.expr(UNIT).alias("DOSE_UNIT_RX"),
        ),
        "MICROBIOLOGYEVENTS": of_kind("error").select(
            *of_user,
            F.expr(SPECIMEN).alias("SPEC_ITEMID"),
            F.date_trunc("day", "ts").alias("CHARTDATE"),
            F.when(F.col("k") >= 5, F.col("ts")).alias("CHARTTIME"),
        ),
        "CHARTEVENTS": of_kind("view", "click", "purchase").select(
            *keys,
            F.expr(ITEM).alias("ITEMID"),
            F.col("ts").alias("CHARTTIME"),
            F.expr(READING).alias("VALUENUM"),
            F.expr(ERROR).alias("ERROR"),
        ),
    }


def records(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return clean_records(raw_tables(spark, folder), dictionaries.antibiotics(spark), key_type="bigint")


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_DAYS = "cast(date_diff('day', DOB, INTIME::DATE) AS DECIMAL(18, 0))"

RECORDS_CTE = f"""
WITH ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
              user_id AS SUBJECT_ID, user_id * 3 + date_diff('day', DATE '2024-01-01', ts::DATE) // 15 + 1000000 AS HADM_ID,
              user_id * 10 + date_diff('day', DATE '2024-01-01', ts::DATE) // 5 + 2000000 AS ICUSTAY_ID FROM events),
 patients AS (SELECT c_custkey AS SUBJECT_ID, CAST(DATE '2009-06-01' - CAST(floor(c_acctbal * 3) AS INT) AS DATE) AS DOB,
              CASE WHEN c_mktsegment = 'FURNITURE' THEN TIMESTAMP '2024-06-01 00:00:00' END AS DOD, {GENDER} AS GENDER,
              CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS EXPIRE_FLAG FROM customer),
 raw_stays AS (SELECT SUBJECT_ID, HADM_ID, ICUSTAY_ID, min(ts) AS INTIME, max(ts) AS OUTTIME,
               CASE WHEN max(value) > 120 THEN 'metavision' ELSE 'carevue' END AS DBSOURCE FROM ev GROUP BY 1, 2, 3),
 icustays AS (SELECT SUBJECT_ID AS subjectID, HADM_ID AS hadmID, ICUSTAY_ID AS icustayID, INTIME AS inTime, OUTTIME AS outTime,
              DOD AS dod, CAST(round(round({_DAYS} / 365.242, 7), 2) AS DOUBLE) AS age, GENDER AS gender, EXPIRE_FLAG AS expired
              FROM raw_stays JOIN patients USING (SUBJECT_ID)
              WHERE DBSOURCE = 'metavision' AND round(round({_DAYS} / 365.242, 7), 2) >= 15.0
                AND round(round({_DAYS} / 365.424, 7), 2) < 90.0),
 prescriptions AS (SELECT SUBJECT_ID AS subjectID, HADM_ID AS hadmID, ICUSTAY_ID AS icustayID,
                coalesce(CASE WHEN k < 97 THEN ts END, TIMESTAMP '1970-01-01 00:00:00') AS startDate,
                coalesce(CASE WHEN k < 50 THEN ts END, TIMESTAMP '1970-01-01 00:00:00') AS endDate,
                {DRUG} AS drug, k::VARCHAR AS value, {UNIT} AS unit
              FROM ev WHERE event_type = 'signup' AND {DRUG_TYPE} = 'MAIN' AND {ROUTE} IN ({_listed(fixed.ROUTES)})
                AND lower({DRUG}) IN ({_listed(fixed.ANTIBIOTICS)}) AND ICUSTAY_ID IN (SELECT icustayID FROM icustays)),
 cultures AS (SELECT SUBJECT_ID AS subjectID, HADM_ID AS hadmID, coalesce(CASE WHEN k >= 5 THEN ts END, date_trunc('day', ts)) AS chartDate
              FROM ev WHERE event_type = 'error' AND {SPECIMEN} = 70012 AND SUBJECT_ID IN (SELECT subjectID FROM icustays)),
 chartevents AS (SELECT SUBJECT_ID AS subjectID, HADM_ID AS hadmID, ICUSTAY_ID AS icustayID, {ITEM} AS itemID, ts AS chartTime, {READING} AS value
              FROM ev WHERE event_type IN ('view', 'click', 'purchase') AND {ERROR} = 0 AND {READING} IS NOT NULL
                AND {ITEM} IN ({', '.join(str(i) for i in fixed.VITAL_ITEMS)})
                AND ICUSTAY_ID IN (SELECT icustayID FROM icustays)),
 bc AS (SELECT hadmID, min(chartDate) AS b FROM cultures GROUP BY 1),
 ab AS (SELECT hadmID, min(startDate) AS a FROM prescriptions GROUP BY 1),
 ix AS (SELECT hadmID, least(a, b) AS t FROM bc JOIN ab USING (hadmID)
        WHERE (b < a AND epoch_ms(a) - epoch_ms(b) <= 86400000) OR (b >= a AND epoch_ms(b) - epoch_ms(a) <= 259200000)),
 al AS (SELECT DISTINCT s.hadmID, coalesce(t, outTime) AS indexDate, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS label
        FROM icustays s LEFT JOIN ix USING (hadmID))"""


def features_cte(value: str) -> str:
    points = " + ".join(
        f"CASE WHEN max(value) FILTER (itemID = {item}) {op} {threshold} THEN 1 ELSE 0 END"
        for item, op, threshold in fixed.SCORE_RULES
    )
    vitals = ", ".join(f"round(max(value) FILTER (itemID = {i}), 6) AS {name}" for i, name in fixed.VITAL_ITEMS.items())
    return f"""
 w AS (SELECT c.hadmID, label, itemID, chartTime, value FROM chartevents c JOIN al USING (hadmID)
       WHERE epoch_us(indexDate) // 1000000 - epoch_us(chartTime) // 1000000 BETWEEN 28800 AND 115200),
 per_item AS (SELECT hadmID, label, itemID, {value} AS value FROM w GROUP BY 1, 2, 3),
 stat AS (SELECT hadmID, arg_min(age, (inTime, icustayID)) AS age,
          arg_min(CASE WHEN gender = 'F' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, (inTime, icustayID)) AS gender
          FROM icustays GROUP BY 1),
 wide AS (SELECT hadmID, label, ({points})::DOUBLE AS score, any_value(age) AS age, any_value(gender) AS gender, {vitals}
          FROM per_item JOIN stat USING (hadmID) GROUP BY 1, 2)"""


LATEST = "arg_max(value, (chartTime, value))"
FEATURE_NAMES = [*fixed.DERIVED_ITEMS.values(), *fixed.VITAL_ITEMS.values()]


def plain_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the given tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query(f"{RECORDS_CTE} SELECT subjectID, hadmID, icustayID, inTime, outTime, dod, age, gender, expired FROM icustays")
def clinical_stays(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(records(spark, folder)["icustays"])


@query(f"{RECORDS_CTE} SELECT subjectID, hadmID, icustayID, startDate, endDate, drug, value, unit FROM prescriptions")
def clinical_prescriptions(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(records(spark, folder)["prescriptions"])


@query(f"{RECORDS_CTE} SELECT subjectID, hadmID, chartDate FROM cultures")
def clinical_cultures(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(records(spark, folder)["microbiologyevents"])


@query(f"{RECORDS_CTE} SELECT subjectID, hadmID, icustayID, itemID, chartTime, value FROM chartevents")
def clinical_vitals(spark: SparkSession, folder: str) -> DataFrame:
    return plain_times(records(spark, folder)["chartevents"])


@query(
    f"""{RECORDS_CTE}
SELECT 'icustays' AS table_name, count(*) AS n_rows FROM icustays UNION ALL SELECT 'prescriptions', count(*) FROM prescriptions
UNION ALL SELECT 'microbiologyevents', count(*) FROM cultures UNION ALL SELECT 'chartevents', count(*) FROM chartevents
"""
)
def clinical_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table_counts(**records(spark, folder))


@query(f"{RECORDS_CTE} SELECT hadmID, indexDate, label FROM al")
def clinical_index(spark: SparkSession, folder: str) -> DataFrame:
    index = index_of(records(spark, folder))
    return index.withColumn("indexDate", F.col("indexDate").cast("timestamp_ntz"))


@query(
    f"""{RECORDS_CTE}
SELECT count(*) FILTER (label = 0) AS controls, count(*) FILTER (label = 1) AS cases, count(*) AS total FROM al
"""
)
def clinical_labels(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(index_of(records(spark, folder)))


@query(f"{RECORDS_CTE}, {features_cte(LATEST)} SELECT hadmID, label, {', '.join(FEATURE_NAMES)} FROM wide")
def clinical_features(spark: SparkSession, folder: str) -> DataFrame:
    return features(records(spark, folder))


@query(f"{RECORDS_CTE}, {features_cte('avg(value)')} SELECT hadmID, label, {', '.join(FEATURE_NAMES)} FROM wide")
def clinical_mean_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = features(records(spark, folder), agg="mean")
    return wide.select(
        "hadmID", "label", *fixed.DERIVED_ITEMS.values(), *[F.round(c, 6).alias(c) for c in fixed.VITAL_ITEMS.values()]
    )


@query(
    f"""{RECORDS_CTE}, {features_cte(LATEST)}
SELECT hadmID, label, itemID, value FROM per_item
UNION ALL SELECT hadmID, label, 1, score FROM wide
UNION ALL SELECT hadmID, label, 2, age FROM wide
UNION ALL SELECT hadmID, label, 3, gender FROM wide
"""
)
def clinical_long_features(spark: SparkSession, folder: str) -> DataFrame:
    return long_feature_table(features(records(spark, folder)), clinical_spec())


# --- dictionaries ------------------------------------------------------------------------------------------------


@query(
    f"""
SELECT DISTINCT lower(DRUG) AS drug FROM (
  SELECT {DRUG} AS DRUG, {DRUG_TYPE} AS DRUG_TYPE, {ROUTE} AS ROUTE, {UNIT} AS DOSE_UNIT_RX
  FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'signup'))
WHERE ({' OR '.join(f"lower(DRUG) LIKE '{p}'" for p in fixed.ANTIBIOTIC_PATTERNS)})
  AND DRUG_TYPE IN ('MAIN', 'ADDITIVE') AND ROUTE IN ({_listed(fixed.ROUTES)})
  AND {' AND '.join(f"lower(ROUTE) NOT LIKE '{p}'" for p in fixed.EXCLUDED_ROUTE_PATTERNS)}
  AND {' AND '.join(f"lower(DRUG) NOT LIKE '{p}'" for p in fixed.EXCLUDED_DRUG_PATTERNS)}
  AND DOSE_UNIT_RX != 'Appl' AND DOSE_UNIT_RX != 'DROP'
ORDER BY drug
"""
)
def drug_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return dictionaries.drug_dictionary(raw_tables(spark, folder)["PRESCRIPTIONS"])


@query(
    f"""
SELECT itemid, label FROM (
  SELECT p_partkey AS itemid, {VITAL_LABEL} AS label, {VITAL_CATEGORY} AS category, {VITAL_SOURCE} AS dbsource FROM part)
WHERE dbsource = 'metavision' AND category IN ({_listed(fixed.VITAL_CATEGORIES)})
  AND ({' OR '.join(f"lower(label) LIKE '{p}'" for p in fixed.VITAL_LABEL_PATTERNS)}
       OR {' OR '.join(f"label LIKE '{p}'" for p in fixed.VITAL_RAW_LABEL_PATTERNS)})
  AND {' AND '.join(f"lower(label) NOT LIKE '{p}'" for p in fixed.EXCLUDED_VITAL_PATTERNS)}
"""
)
def vital_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("itemid"),
        F.expr(VITAL_LABEL).alias("label"),
        F.expr(VITAL_CATEGORY).alias("category"),
        F.expr(VITAL_SOURCE).alias("dbsource"),
    )
    return dictionaries.vital_dictionary(items)


@query(
    f"""
SELECT icd9_code, short_title, long_title FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS icd9_code, {SHORT_TITLE} AS short_title, {LONG_TITLE} AS long_title FROM part)
WHERE ({' OR '.join(f"lower(long_title) LIKE '{p}'" for p in fixed.DIAGNOSIS_LONG_PATTERNS)}
       OR lower(short_title) LIKE '%septic shock%')
  AND {' AND '.join(f"lower(long_title) NOT LIKE '{p}'" for p in fixed.EXCLUDED_DIAGNOSIS_PATTERNS)}
  AND lower(long_title) NOT IN ({_listed(fixed.EXCLUDED_DIAGNOSES)})
"""
)
def diagnosis_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    diagnoses = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("icd9_code"),
        F.expr(SHORT_TITLE).alias("short_title"),
        F.expr(LONG_TITLE).alias("long_title"),
    )
    return dictionaries.diagnosis_dictionary(diagnoses)
