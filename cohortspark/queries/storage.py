"""Scans, dictionaries, checkpoints and feature files. Each query writes a given table and reads it back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.layout import item_positions, sparse_features
from cohortspark.plans.clinical import record_steps
from cohortspark.plans.dictionaries import antibiotics
from cohortspark.plans.feature_sets import feature_vectors
from cohortspark.queries.clinical import RECORDS_CTE, raw_tables
from cohortspark.queries.events import (
    FEATURE_COLUMNS,
    INDEX_CTE,
    SPEC,
    SWEPT_HOURS,
    WIDE_SQL,
    feature_frame,
    sweep_frame,
    wide_cte,
)
from cohortspark.queries.registry import query, table
from cohortspark.sources import (
    checkpoint_or_reload,
    durable,
    feature_set_path,
    infer_table_name,
    published_counts,
    read_csv_table,
    read_dictionary_ids,
    read_dictionary_text,
    read_feature_sets,
    read_libsvm,
    read_typed_csv,
    shared_folder,
    sweep_feature_sets,
    write_feature_sets,
    write_libsvm,
)


@query("SELECT * FROM orders")
def csv_scan_named_view(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = f"{shared_folder(spark)}/scanned_orders.csv"
    orders.write.option("header", True).csv(path)
    read_csv_table(spark, path, orders.schema)
    return spark.table(infer_table_name(path))


#: Orders as lines of a file: some lack the last field, some have one too many, some hold a price that is no number.
BROKEN_LINE = """CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey || ',' || o_orderstatus
 WHEN o_orderkey % 77 = 9 THEN o_orderkey || ',' || o_orderstatus || ',' || o_custkey || ',0,0'
 WHEN o_orderkey % 101 = 11 THEN o_orderkey || ',' || o_orderstatus || ',' || 'n/a' || ',' || o_orderpriority
 ELSE o_orderkey || ',' || o_orderstatus || ',' || o_custkey || ',' || o_orderpriority END"""
IS_BROKEN = "(o_orderkey % 50 = 7 OR o_orderkey % 77 = 9 OR o_orderkey % 101 = 11)"


def broken_file(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_folder(spark)}/broken_orders.csv"
    lines = table(spark, folder, "orders").select(F.expr(BROKEN_LINE).alias("o_orderkey,o_orderstatus,o_custkey,o_orderpriority"))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)  # whole lines, nothing to quote
    return read_typed_csv(spark, path, {"o_custkey": "BIGINT", "o_orderkey": "BIGINT", "o_orderpriority": "STRING"})


@query(f"SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE NOT {IS_BROKEN}")
def csv_typed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return broken_file(spark, folder)[0]


@query(f"SELECT {BROKEN_LINE} AS line FROM orders WHERE {IS_BROKEN}")
def csv_rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    return broken_file(spark, folder)[1]


@query(
    f"""{RECORDS_CTE}
SELECT 'icustays' AS table_name, count(*) AS n_rows FROM icustays UNION ALL SELECT 'prescriptions', count(*) FROM prescriptions
UNION ALL SELECT 'microbiologyevents', count(*) FROM cultures UNION ALL SELECT 'chartevents', count(*) FROM chartevents
"""
)
def checkpoint_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the saved record tables, as published with them."""
    path, raw = shared_folder(spark), raw_tables(spark, folder)
    checkpoint_or_reload(spark, path, record_steps(raw.__getitem__, antibiotics(spark), key_type="bigint"))
    return published_counts(spark, path)


@query("SELECT * FROM events")
def parquet_checkpoint_reload(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)

    build = {"events": lambda saved: table(spark, folder, "events")}
    checkpoint_or_reload(spark, path, build, reload=True)
    return checkpoint_or_reload(spark, path, build)["events"]


@query("SELECT DISTINCT lower(p_brand || ' ' || p_name) AS value FROM part")
def dictionary_text_distinct(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    table(spark, folder, "part").select(F.concat_ws(" ", "p_brand", "p_name")).write.text(path)
    return read_dictionary_text(spark, path)


@query("SELECT DISTINCT l_partkey AS itemid FROM lineitem")
def dictionary_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/item_ids.csv"
    items = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("itemid"), F.col("l_linestatus").alias("label"))
    items.write.option("header", True).csv(path)
    return read_dictionary_ids(spark, path, schema="itemid BIGINT, label STRING")


def _elements(vectors: DataFrame, *keep: str) -> DataFrame:
    values = vector_to_array("features")
    return vectors.select(*keep, "label", *[values[i].alias(name) for i, name in enumerate(FEATURE_COLUMNS)])


@query(f"SELECT label::DOUBLE AS label, {', '.join(FEATURE_COLUMNS)} FROM ({WIDE_SQL})")
def libsvm_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    write_libsvm(feature_vectors(feature_frame(spark, folder), SPEC), path)
    return _elements(read_libsvm(spark, path, len(FEATURE_COLUMNS)))


@query(f"SELECT user_id, label::DOUBLE AS label, {', '.join(FEATURE_COLUMNS)} FROM ({WIDE_SQL})")
def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _elements(feature_vectors(feature_frame(spark, folder), SPEC), "user_id")


@query(
    f"""
{INDEX_CTE}, {wide_cte('latest', swept=True)}
SELECT pred_hours AS window_hours, count(*) AS n_rows, count(*) FILTER (label = 1) AS cases,
       round(sum(score), 6) AS score_sum
FROM wide GROUP BY 1
"""
)
def feature_set_sweep(spark: SparkSession, folder: str) -> DataFrame:
    base = shared_folder(spark)
    write_feature_sets(feature_vectors(sweep_frame(spark, folder), SPEC), f"{base}/swept")
    for hours in SWEPT_HOURS:
        write_libsvm(read_feature_sets(spark, f"{base}/swept", hours), feature_set_path(base, 24, hours))
    sets = [
        df.withColumn("window_hours", F.lit(window))
        for window, df in sweep_feature_sets(spark, f"{base}/svmoutput24", len(FEATURE_COLUMNS))
    ]
    stacked = sets[0]
    for other in sets[1:]:
        stacked = stacked.unionByName(other)
    return stacked.groupBy("window_hours").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("cases"),
        F.round(F.sum(vector_to_array("features")[0]), 6).alias("score_sum"),
    )


@query(
    f"""
{INDEX_CTE}, {wide_cte('latest', swept=True)}
SELECT pred_hours, label, count(*) AS n_rows, round(sum(score), 6) AS score_sum
FROM wide WHERE pred_hours <> 4 OR label = 1 GROUP BY 1, 2
"""
)
def feature_set_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """One prediction window of a saved sweep is written anew, from its cases only; the others stay."""
    path = f"{shared_folder(spark)}/swept"
    write_feature_sets(sweep_frame(spark, folder), path)
    again = read_feature_sets(spark, path).where("pred_hours = 4 AND label = 1")
    write_feature_sets(durable(again), path, only_these=True)
    grouped = read_feature_sets(spark, path).groupBy("pred_hours", "label")
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("score"), 6).alias("score_sum"))


ITEM_SQL = """
WITH l AS (SELECT l_suppkey, l_partkey || '/' || l_orderkey AS item, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
 p AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS position, count(*) OVER () AS width FROM (SELECT DISTINCT item FROM l))"""


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """One item for each part of each order: about as many as there are lines."""
    item = F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"))
    lines = table(spark, folder, "lineitem").select("l_suppkey", item.alias("item"), "l_quantity")
    return lines.groupBy("l_suppkey", "item").agg(F.sum("l_quantity").alias("value"))


@query(f"{ITEM_SQL} SELECT item, position, width FROM p")
def item_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of all items, from ranges of the items."""
    return item_positions(line_items(spark, folder), "item")


@query(f"{ITEM_SQL} SELECT l_suppkey, width, position AS place, value FROM l JOIN p USING (item)")
def sparse_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse vectors over all items, one for each supplier, as their places and values."""
    long = line_items(spark, folder)
    features = sparse_features(long, ["l_suppkey"], "item", "value", item_positions(long, "item"))
    pairs = F.explode(F.arrays_zip("indices", "values")).alias("p")
    return features.select("l_suppkey", "width", pairs).select("l_suppkey", "width", F.col("p.indices").alias("place"), F.col("p.values").alias("value"))
