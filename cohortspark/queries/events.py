"""Index times and observation-window features over the ``events`` table.

A user stands for an entity and ten days of a user for a stay; an ``error`` is the second kind of index event
and a ``signup`` the first; views, clicks and purchases are the measured items.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import category_code, replace_sentinel
from cohortspark.operators import features as feature_ops
from cohortspark.operators import timeframe
from cohortspark.operators.crowded import count_windows, means_counted
from cohortspark.operators.features import Rule
from cohortspark.operators.joins import join_demographics
from cohortspark.plans.feature_sets import MANY_WINDOWS, FeatureSpec, feature_table, long_feature_table
from cohortspark.plans.feature_sets import window_sweep as sweep
from cohortspark.queries.registry import query, table
from cohortspark.sources.checkpoints import durable

RULES = (Rule("purchase", "<", 15.0), Rule("click", "<=", 100.0), Rule("view", ">=", 22.0))
ITEMS = {"click": "click", "purchase": "purchase", "view": "view"}
DERIVED = {"1_score": "score", "2_balance": "balance", "3_segment": "segment"}
FEATURE_COLUMNS = ("score", "balance", "segment", "click", "purchase", "view")
KEYS = ["user_id", "label"]
SWEPT_HOURS = (1, 2, 4, 6, 8)

SPEC = FeatureSpec(
    entity="user_id",
    item="event_type",
    value="value",
    time="ts",
    tie_break="event_id",
    items=ITEMS,
    derived=DERIVED,
    rules=RULES,
    static={
        "balance": lambda: replace_sentinel("c_acctbal"),
        "segment": lambda: category_code("c_mktsegment", "MACHINERY"),
    },
    stay_order=("in_ts", "stay"),
)


def kind(spark: SparkSession, folder: str, event_type: str) -> DataFrame:
    return table(spark, folder, "events").where(F.col("event_type") == event_type).select("user_id", "ts")


def stays(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.floor(day / 10).alias("stay"))
        .agg(F.min("ts").alias("in_ts"), F.max("ts").alias("out_ts"))
    )


def described_stays(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment")
    return join_demographics(stays(spark, folder), customers, "user_id")


def index_frame(spark: SparkSession, folder: str) -> DataFrame:
    return timeframe.index_dates(
        stays(spark, folder),
        kind(spark, folder, "signup"),
        kind(spark, folder, "error"),
        entity="user_id",
        out_time="out_ts",
        a_time="ts",
        b_time="ts",
    )


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where(F.col("event_type").isin(*ITEMS)).drop("props")


def windowed_frame(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.observation_window_join(
        measured(spark, folder), index_frame(spark, folder), entity="user_id", time="ts", pred_hours=8, obs_hours=24
    )


def covered_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Every event once for each label that it is in a window of."""
    return feature_ops.events_in_any_window(
        measured(spark, folder), index_frame(spark, folder), entity="user_id", time="ts", pred_hours=8, obs_hours=24
    )


def latest_frame(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.latest_per_item(
        covered_frame(spark, folder), KEYS, "event_type", "value", "ts", "event_id"
    )


def mean_frame(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.mean_per_item(windowed_frame(spark, folder), KEYS, "event_type", "value")


def feature_frame(
    spark: SparkSession, folder: str, agg: str = "latest", many_windows: int = MANY_WINDOWS
) -> DataFrame:
    return feature_table(
        index_frame(spark, folder),
        table(spark, folder, "events"),
        described_stays(spark, folder),
        SPEC,
        agg=agg,
        many_windows=many_windows,
    )


def sweep_frame(spark: SparkSession, folder: str) -> DataFrame:
    return sweep(
        index_frame(spark, folder), table(spark, folder, "events"), described_stays(spark, folder), SPEC, SWEPT_HOURS
    )


def filled(features: DataFrame) -> DataFrame:
    return features.na.fill(0.0, list(FEATURE_COLUMNS))


# --- equivalent SQL ----------------------------------------------------------------------------------------------

INDEX_CTE = """
WITH st AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 10 AS stay, min(ts) AS in_ts,
            max(ts) AS out_ts FROM events GROUP BY 1, 2),
 bc AS (SELECT user_id, min(ts) AS b FROM events WHERE event_type = 'error' GROUP BY 1),
 ab AS (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'signup' GROUP BY 1),
 ix AS (SELECT user_id, a, b, least(a, b) AS t FROM bc JOIN ab USING (user_id)
        WHERE (b < a AND epoch_ms(a) - epoch_ms(b) <= 86400000) OR (b >= a AND epoch_ms(b) - epoch_ms(a) <= 259200000)),
 al AS (SELECT DISTINCT st.user_id, coalesce(t, out_ts) AS index_time, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS label
        FROM st LEFT JOIN ix USING (user_id))"""

WINDOW_CTE = """
 w AS (SELECT e.user_id, label, event_type, ts, event_id, value FROM events e JOIN al USING (user_id)
       WHERE event_type IN ('view', 'click', 'purchase')
         AND epoch_us(index_time) // 1000000 - epoch_us(ts) // 1000000 BETWEEN 28800 AND 115200)"""

LATEST_CTE = """
 lat AS (SELECT user_id, label, event_type, value FROM w
         QUALIFY row_number() OVER (PARTITION BY user_id, label, event_type ORDER BY ts DESC, event_id DESC) = 1)"""

MEAN_CTE = " lat AS (SELECT user_id, label, event_type, avg(value) AS value FROM w GROUP BY 1, 2, 3)"

SCORE = """sum(CASE WHEN event_type = 'purchase' AND value < 15 THEN 1 WHEN event_type = 'click' AND value <= 100 THEN 1
 WHEN event_type = 'view' AND value >= 22 THEN 1 ELSE 0 END)::DOUBLE"""

STATIC_CTE = """
 stat AS (SELECT user_id, balance, segment FROM (
   SELECT st.user_id, CASE WHEN c_acctbal = 300 THEN 90.0::DOUBLE ELSE c_acctbal END AS balance,
     CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS segment,
     row_number() OVER (PARTITION BY st.user_id ORDER BY in_ts, stay) AS rn
   FROM st JOIN customer ON c_custkey = st.user_id) WHERE rn = 1)"""


def wide_cte(agg: str, swept: bool = False) -> str:
    """Window, value per item, score and static attributes as wide rows named ``wide``."""
    hours = ", ".join(f"({h})" for h in SWEPT_HOURS) if swept else "(8)"
    value = "avg(value)" if agg == "mean" else "arg_max(value, (ts, event_id))"
    return f"""
 hrs(pred_hours) AS (VALUES {hours}),
 w AS (SELECT e.user_id, label, pred_hours, event_type, ts, event_id, value
       FROM events e JOIN al USING (user_id), hrs
       WHERE event_type IN ('view', 'click', 'purchase')
         AND epoch_us(index_time) // 1000000 - epoch_us(ts) // 1000000
             BETWEEN pred_hours * 3600 AND (pred_hours + 24) * 3600),
 lat AS (SELECT user_id, label, pred_hours, event_type, {value} AS value FROM w GROUP BY 1, 2, 3, 4),
 {STATIC_CTE},
 wide AS (SELECT user_id, label, pred_hours, {SCORE} AS score, any_value(balance) AS balance,
          any_value(segment) AS segment,
          coalesce(max(value) FILTER (event_type = 'click'), 0) AS click,
          coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS purchase,
          coalesce(max(value) FILTER (event_type = 'view'), 0) AS view
          FROM lat JOIN stat USING (user_id) GROUP BY 1, 2, 3)"""


def rounded(columns: tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


WIDE_SQL = f"""
{INDEX_CTE}, {wide_cte('latest')}
SELECT user_id, label, {', '.join(FEATURE_COLUMNS)} FROM wide
"""


# --- index times -------------------------------------------------------------------------------------------------


@query("SELECT user_id, min(ts) AS first_time FROM events WHERE event_type = 'error' GROUP BY 1")
def first_event_time(spark: SparkSession, folder: str) -> DataFrame:
    return timeframe.first_event_time(kind(spark, folder, "error"), "user_id", "ts", "first_time")


@query(
    """
WITH bc AS (SELECT user_id, min(ts) AS first_b FROM events WHERE event_type = 'error' GROUP BY 1),
 ab AS (SELECT user_id, min(ts) AS first_a FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT user_id, first_a, first_b, CASE WHEN first_b < first_a THEN 'B' ELSE 'A' END AS kind
FROM bc JOIN ab USING (user_id)
"""
)
def first_event_kind(spark: SparkSession, folder: str) -> DataFrame:
    pairs = timeframe.pair_first_events(
        kind(spark, folder, "signup"), kind(spark, folder, "error"), "user_id", "ts", "ts"
    )
    return pairs.select(
        "user_id",
        F.col("first_a").cast("timestamp_ntz").alias("first_a"),
        F.col("first_b").cast("timestamp_ntz").alias("first_b"),
        timeframe.first_kind().alias("kind"),
    )


@query(f"{INDEX_CTE} SELECT user_id, index_time, label FROM al")
def index_dates(spark: SparkSession, folder: str) -> DataFrame:
    index = index_frame(spark, folder)
    return index.withColumn("index_time", F.col("index_time").cast("timestamp_ntz"))


@query(
    f"""
{INDEX_CTE}
SELECT count(*) FILTER (label = 0) AS controls, count(*) FILTER (label = 1) AS cases, count(*) AS total FROM al
"""
)
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return timeframe.label_counts(index_frame(spark, folder))


# --- observation window ------------------------------------------------------------------------------------------


@query(f"{INDEX_CTE}, {WINDOW_CTE} SELECT user_id, label, event_type, ts, event_id, value FROM w")
def observation_window_events(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_frame(spark, folder).select("user_id", "label", "event_type", "ts", "event_id", "value")


@query(f"{INDEX_CTE}, {WINDOW_CTE}, {LATEST_CTE} SELECT user_id, label, event_type, value FROM lat")
def latest_per_item(spark: SparkSession, folder: str) -> DataFrame:
    return latest_frame(spark, folder)


@query(f"{INDEX_CTE}, {WINDOW_CTE}, {MEAN_CTE} SELECT user_id, label, event_type, round(value, 6) AS value FROM lat")
def mean_per_item(spark: SparkSession, folder: str) -> DataFrame:
    """From the number of windows that each second is in, so that no event is joined to its windows."""
    counted = count_windows(
        measured(spark, folder), durable(index_frame(spark, folder)), entity="user_id", item="event_type", value="value",
        time="ts", index_time="index_time", label="label", pred_hours=[8], obs_hours=24,
    )
    return means_counted(counted, KEYS, "event_type", "value").withColumn("value", F.round("value", 6))


@query(
    f"""
{INDEX_CTE}, {WINDOW_CTE}
SELECT user_id, label, event_type, round(avg(value), 6) AS value
FROM (SELECT DISTINCT user_id, label, event_type, event_id, value FROM w) GROUP BY 1, 2, 3
"""
)
def mean_per_item_once(spark: SparkSession, folder: str) -> DataFrame:
    means = feature_ops.mean_per_item(covered_frame(spark, folder), KEYS, "event_type", "value")
    return means.withColumn("value", F.round("value", 6))


@query(f"{INDEX_CTE}, {WINDOW_CTE}, {LATEST_CTE} SELECT user_id, label, {SCORE} AS score FROM lat GROUP BY 1, 2")
def risk_score_latest(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.risk_score(latest_frame(spark, folder), KEYS, "event_type", "value", RULES)


@query(f"{INDEX_CTE}, {WINDOW_CTE}, {MEAN_CTE} SELECT user_id, label, {SCORE} AS score FROM lat GROUP BY 1, 2")
def risk_score_mean(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.risk_score(mean_frame(spark, folder), KEYS, "event_type", "value", RULES)


# --- static attributes and layout --------------------------------------------------------------------------------


@query(
    f"""
{INDEX_CTE}, {STATIC_CTE}
SELECT user_id, '2_balance' AS event_type, balance AS value FROM stat
UNION ALL SELECT user_id, '3_segment', segment FROM stat
"""
)
def static_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    static = feature_ops.dedupe_static(described_stays(spark, folder), "user_id", SPEC.static_columns(), SPEC.stay_order)
    return feature_ops.unpivot_static(
        static, ["user_id"], {"balance": "2_balance", "segment": "3_segment"}, "event_type", "value"
    )


LONG_SQL = f"""
{INDEX_CTE}, {WINDOW_CTE}, {LATEST_CTE}, {STATIC_CTE},
 adm AS (SELECT DISTINCT user_id, label FROM lat)
SELECT user_id, label, event_type, value FROM lat
UNION ALL SELECT user_id, label, '1_score', {SCORE} FROM lat GROUP BY 1, 2
UNION ALL SELECT user_id, label, '2_balance', balance FROM adm JOIN stat USING (user_id)
UNION ALL SELECT user_id, label, '3_segment', segment FROM adm JOIN stat USING (user_id)
"""


def long_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Vitals, score and static attributes stacked from separate long tables."""
    latest = durable(latest_frame(spark, folder))  # three parts read it
    score = feature_ops.risk_score(latest, KEYS, "event_type", "value", RULES, "value").select(
        *KEYS, F.lit("1_score").alias("event_type"), "value"
    )
    static = feature_ops.dedupe_static(described_stays(spark, folder), "user_id", SPEC.static_columns(), SPEC.stay_order)
    attached = feature_ops.attach_static(score.select(*KEYS), static, "user_id")
    described = feature_ops.unpivot_static(
        attached, KEYS, {"balance": "2_balance", "segment": "3_segment"}, "event_type", "value"
    )
    return feature_ops.long_features(latest, described, score)


@query(LONG_SQL)
def long_features(spark: SparkSession, folder: str) -> DataFrame:
    return long_frame(spark, folder)


@query(LONG_SQL)
def long_features_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    return long_feature_table(feature_frame(spark, folder), SPEC)


@query(
    f"""
SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS position
FROM (SELECT DISTINCT event_type FROM ({LONG_SQL}))
"""
)
def feature_index(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.feature_index(long_frame(spark, folder), "event_type")


@query(WIDE_SQL)
def wide_features(spark: SparkSession, folder: str) -> DataFrame:
    return filled(feature_frame(spark, folder))


@query(WIDE_SQL)
def pivoted_features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.pivot_items(long_frame(spark, folder), KEYS, SPEC.feature_items(), "event_type", "value")


@query(WIDE_SQL)
def wide_features_counted(spark: SparkSession, folder: str) -> DataFrame:
    """The same from latest values in long form, each event joined to one row for all windows of its slice of time."""
    wide = feature_ops.pivot_items(latest_frame(spark, folder), KEYS, ITEMS, "event_type", "value", fill=None)
    scored = wide.withColumn("score", feature_ops.wide_score(RULES, ITEMS))
    static = feature_ops.dedupe_static(described_stays(spark, folder), "user_id", SPEC.static_columns(), SPEC.stay_order)
    return filled(feature_ops.attach_static(scored, static, "user_id")).select(*KEYS, *FEATURE_COLUMNS)


def crowded_sql(value: str) -> str:
    columns = ", ".join(f"{value} FILTER (event_type = '{name}') AS {name}" for name in ITEMS)
    return f"""
WITH e AS (SELECT user_id % 5 AS user_id, event_type, ts, event_id, value FROM events),
 ix AS (SELECT user_id % 5 AS user_id, ts AS index_time, CAST(nullif(event_id % 4, 3) AS INT) AS label FROM events),
 w AS (SELECT e.user_id, label, event_type, ts, event_id, value FROM e JOIN ix USING (user_id)
       WHERE event_type IN ('view', 'click', 'purchase')
         AND epoch_us(index_time) // 1000000 - epoch_us(ts) // 1000000 BETWEEN 28800 AND 115200)
SELECT user_id, label, {columns} FROM w GROUP BY 1, 2
"""


def crowded_frame(spark: SparkSession, folder: str, agg: str) -> DataFrame:
    """Five entities with every event of theirs as an index row, and labels 0, 1, 2 and NULL."""
    events = table(spark, folder, "events").withColumn("user_id", F.col("user_id") % 5)
    label = F.nullif(F.col("event_id") % 4, F.lit(3)).cast("int")
    index = events.select("user_id", F.col("ts").alias("index_time"), label.alias("label"))
    spec = replace(SPEC, derived={}, rules=(), static={})
    return feature_table(index, events, events, spec, agg=agg)


@query(crowded_sql("arg_max(value, (ts, event_id))"))
def crowded_features(spark: SparkSession, folder: str) -> DataFrame:
    return crowded_frame(spark, folder, "latest")


@query(f"SELECT user_id, label, {', '.join(f'round({n}, 6) AS {n}' for n in ITEMS)} FROM ({crowded_sql('avg(value)')})")
def crowded_mean_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = crowded_frame(spark, folder, "mean")
    return wide.withColumns({name: F.round(name, 6) for name in ITEMS})


WIDE_MEAN_SQL = f"""
{INDEX_CTE}, {wide_cte('mean')}
SELECT user_id, label, {rounded(FEATURE_COLUMNS)} FROM wide
"""


def rounded_frame(wide: DataFrame) -> DataFrame:
    return wide.select(*KEYS, *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


@query(WIDE_MEAN_SQL)
def wide_mean_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_frame(filled(feature_frame(spark, folder, "mean")))


@query(WIDE_MEAN_SQL)
def wide_mean_features_counted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_frame(filled(feature_frame(spark, folder, "mean", many_windows=0)))


@query(
    f"""
{INDEX_CTE}, {wide_cte('latest', swept=True)}
SELECT user_id, label, pred_hours, {', '.join(FEATURE_COLUMNS)} FROM wide
"""
)
def window_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return filled(sweep_frame(spark, folder))
