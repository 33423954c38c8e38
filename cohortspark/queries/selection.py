"""Cohort filters, pattern filters, joins with a cohort and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import functions
from cohortspark.functions import (
    age_in_years,
    apply_threshold,
    first_present,
    null_to_epoch,
    parse_number,
    replace_sentinel,
)
from cohortspark.operators.filters import (
    exclude_any_pattern,
    filter_age_band,
    filter_equals,
    filter_in_dictionary,
    filter_in_list,
    filter_not_null,
    match_any_pattern,
    not_equal,
    not_in_literals,
)
from cohortspark.operators.joins import join_demographics, semi_join
from cohortspark.operators.pattern_table import exclude_any_of, match_any_of, matched_patterns
from cohortspark.operators.timeframe import table_counts as count_tables
from cohortspark.queries.registry import query, table
from cohortspark.sources.tables import distinct_lower

BIRTH = "1920-01-01"


def _age_sql(year_days: str) -> str:
    days = "date_diff('day', DATE '1920-01-01', o_orderdate::DATE)"
    return f"round(round(cast({days} AS DECIMAL(18, 0)) / {year_days}, 7), 2)"


@query(
    f"""
SELECT o_orderkey, o_custkey, c_nationkey, CAST({_age_sql('365.242')} AS DOUBLE) AS age
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' AND {_age_sql('365.242')} >= 76.0 AND {_age_sql('365.424')} < 80.0
"""
)
def age_band_cohort(spark: SparkSession, folder: str) -> DataFrame:
    persons = filter_equals(table(spark, folder, "customer"), c_mktsegment="MACHINERY").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = join_demographics(orders, persons, "o_custkey").withColumn("birth", F.lit(BIRTH).cast("date"))
    return filter_age_band(joined, "o_orderdate", "birth", 76.0, 80.0).select(
        "o_orderkey", "o_custkey", "c_nationkey", age_in_years("o_orderdate", "birth").alias("age")
    )


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')
"""
)
def semi_join_cohort(spark: SparkSession, folder: str) -> DataFrame:
    urgent = filter_equals(table(spark, folder, "orders"), o_orderpriority="1-URGENT")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return semi_join(lines, urgent, "l_orderkey", "o_orderkey")


@query(
    """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
"""
)
def semi_join_by_map(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a map of the keys' hashes applied before the join, as for keys that outgrow a broadcast."""
    urgent = filter_equals(table(spark, folder, "orders"), o_orderpriority="1-URGENT", o_orderstatus="F")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return semi_join(lines, urgent, "l_orderkey", "o_orderkey", prefilter=True)


@query(
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""
)
def in_subquery_cohort(spark: SparkSession, folder: str) -> DataFrame:
    builders = filter_equals(table(spark, folder, "customer"), c_mktsegment="BUILDING")
    return semi_join(table(spark, folder, "orders"), builders, "o_custkey", "c_custkey").select(
        "o_orderkey", "o_totalprice"
    )


@query(
    """
SELECT p_partkey, p_name FROM part
WHERE lower(p_name) IN (SELECT DISTINCT lower(p_name) FROM part WHERE p_brand = 'Brand#7' AND p_type = 'PROMO')
"""
)
def dictionary_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    names = distinct_lower(filter_equals(part, p_brand="Brand#7", p_type="PROMO"), "p_name")
    return filter_in_dictionary(part.select("p_partkey", "p_name"), "p_name", names)


DOCUMENT_PATTERNS = ("%license%", "%copyright%", "%password%", "%@%", "%http%", "%Never in lower case%")


@query(
    f"""
SELECT doc_id, lang, n_chars FROM documents
WHERE {' OR '.join(f"lower(text) LIKE '{p}'" for p in DOCUMENT_PATTERNS)}
"""
)
def dictionary_like_any(spark: SparkSession, folder: str) -> DataFrame:
    found = match_any_pattern(table(spark, folder, "documents"), "text", DOCUMENT_PATTERNS)
    return found.select("doc_id", "lang", "n_chars")


PHRASES_CTE = """
WITH w AS (SELECT string_split(lower(text), ' ') AS words FROM benchmark),
 p AS (SELECT DISTINCT '%' || words[i] || ' ' || words[i + 1] || '%' AS pattern
       FROM (SELECT words, unnest(range(1, len(words))) AS i FROM w)
       UNION SELECT DISTINCT '%' || p_name || '_%s' FROM part),
 m AS (SELECT doc_id, pattern FROM documents JOIN p ON lower(text) LIKE pattern)"""


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary of thousands of LIKE patterns: neighbouring words of the benchmark, and names of parts."""
    words = F.split(F.lower("text"), " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat(F.lit("%"), a, F.lit(" "), b, F.lit("%")))
    found = table(spark, folder, "benchmark").select(F.explode(pairs).alias("pattern"))
    names = table(spark, folder, "part").select(F.concat(F.lit("%"), "p_name", F.lit("_%s")).alias("pattern"))
    return found.unionByName(names).distinct()


@query(f"{PHRASES_CTE} SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM m)")
def pattern_table_any(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    return match_any_of(docs, "text", phrases(spark, folder)).select("doc_id", "lang", "n_chars")


@query(f"{PHRASES_CTE} SELECT doc_id, lang, n_chars FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM m)")
def pattern_table_none(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    return exclude_any_of(docs, "text", phrases(spark, folder)).select("doc_id", "lang", "n_chars")


@query(f"{PHRASES_CTE} SELECT doc_id, pattern FROM m")
def pattern_table_matches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return matched_patterns(docs, "text", phrases(spark, folder)).select("doc_id", F.explode("patterns").alias("pattern"))


@query(
    """
SELECT DISTINCT lower(p_name) AS value FROM part
WHERE p_type IN ('PROMO', 'LARGE', 'SMALL')
  AND (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%gear%')
  AND lower(p_name) NOT LIKE '%red%' AND lower(p_name) NOT LIKE '%blue%' AND p_brand != 'Brand#3'
ORDER BY value
"""
)
def dictionary_like_exclude(spark: SparkSession, folder: str) -> DataFrame:
    part = filter_in_list(table(spark, folder, "part"), "p_type", ["PROMO", "LARGE", "SMALL"])
    kept = match_any_pattern(part, "p_name", ["%ring%", "%bolt%", "%gear%"])
    kept = exclude_any_pattern(kept, "p_name", ["%red%", "%blue%"])
    return distinct_lower(not_equal(kept, "p_brand", "Brand#3"), "p_name").orderBy("value")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) NOT IN ('economy', 'small')")
def dictionary_not_in(spark: SparkSession, folder: str) -> DataFrame:
    return not_in_literals(table(spark, folder, "part"), "p_type", ["economy", "small"]).select("p_partkey", "p_type")


@query("SELECT p_partkey, nullif(p_type, 'PROMO') AS unit FROM part WHERE nullif(p_type, 'PROMO') != 'SMALL'")
def not_equal_null_drop(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "part").select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("unit"))
    return not_equal(units, "unit", "SMALL")


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE nullif(event_type, 'error') IS NOT NULL")
def not_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return filter_not_null(kinds, "kind")


@query(
    """
SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN ts END, date_trunc('day', ts)) AS at_time FROM events
"""
)
def null_time_fallback(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("ts")).alias("chart_time"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("chart_date"),
    )
    return events.select("event_id", first_present("chart_time", "chart_date").alias("at_time"))


@query(
    """
SELECT event_id, coalesce(CASE WHEN event_type <> 'signup' THEN ts END, TIMESTAMP '1970-01-01 00:00:00') AS at_time
FROM events
"""
)
def null_time_epoch(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("ts")).alias("start")
    )
    return events.select("event_id", null_to_epoch("start").cast("timestamp_ntz").alias("at_time"))


@query("SELECT o_orderkey, o_totalprice AS price, TRUE AS priority_is_nan FROM orders")
def parse_double(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.format_number("o_totalprice", 2).alias("shown"), "o_orderpriority"
    )
    return orders.select(
        "o_orderkey",
        parse_number("shown").alias("price"),
        F.isnan(parse_number("o_orderpriority")).alias("priority_is_nan"),
    )


@query(
    """
SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'MACHINERY') = 'HOUSEHOLD' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS code
FROM customer
"""
)
def category_code(spark: SparkSession, folder: str) -> DataFrame:
    segments = table(spark, folder, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment")
    )
    return segments.select("c_custkey", functions.category_code("segment", "HOUSEHOLD").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size = 30 THEN 90.0::DOUBLE ELSE p_size::DOUBLE END AS age FROM part")
def sentinel_age(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("age"))
    return sizes.select("p_partkey", replace_sentinel("age", sentinel=30.0).alias("age"))


@query("SELECT event_id, CAST(value > 50.0 AS INT) AS predicted FROM events")
def threshold_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", apply_threshold("value", 50.0).alias("predicted"))


@query(
    """
SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'documents', count(*) FROM documents
"""
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tables(**{name: table(spark, folder, name) for name in ("orders", "lineitem", "events", "documents")})


@query(
    """
SELECT event_id, try_strptime(CASE WHEN event_type = 'error' THEN 'none' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END,
  '%d/%m/%Y %H:%M:%S') AS at_time FROM events
"""
)
def parse_time(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    events = table(spark, folder, "events").select("event_id", shown.alias("shown"))
    return events.select("event_id", functions.to_time("shown", "dd/MM/yyyy HH:mm:ss").cast("timestamp_ntz").alias("at_time"))
