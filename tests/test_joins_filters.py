from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import filters
from cohortspark.operators.joins import _bytes, fits_in_broadcast, in_key_map, join_demographics, key_map, semi_join, spread_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are exact copies of one row, the others spread over many keys."""
    hot = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("k"), F.lit(1).alias("v"))
    rest = spark.range(0, 6000, 1, 6).select((F.col("id") % 500).alias("k"), (F.col("id") % 11).cast("int").alias("v"))
    return hot.unionByName(rest).withColumn("null_k", F.when(F.col("k") != 3, F.col("k")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, rows, how):
    small = spark.range(0, 900, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = spread_join(skewed, small, "k", how, salts=1)
    salted = spread_join(skewed, small, "k", how, salts=8)
    assert rows(plain) == rows(salted)
    assert salted.columns == plain.columns


def test_salts_spread_copies_of_one_row(spark, skewed):
    small = spark.range(0, 900).select(F.col("id").alias("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(skewed, small, "k", salts=6)
        sizes = joined.where("k = 7 AND v = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000
        assert not fits_in_broadcast(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert fits_in_broadcast(spark.range(10))


def test_size_settings():
    assert _bytes("10485760b") == _bytes("10MB") == _bytes("10m") == 10485760
    assert _bytes("-1") == -1 and _bytes("2g") == 2 * 1024**3


def test_unsupported_join_type_is_refused(spark):
    with pytest.raises(ValueError):
        spread_join(spark.range(1), spark.range(1), "id", "full")


def test_semi_join_keeps_copies_and_drops_null_keys(spark, skewed, rows):
    ids = spark.createDataFrame([(7,), (7,), (None,)], "other long")
    expected = [(7, 1)] * 3000
    got = semi_join(skewed, ids, "null_k", "other").where("v = 1").select("k", "v")
    hot = skewed.where("k = 7 AND v = 1").select("k", "v")
    assert rows(got) == rows(hot) and rows(got)[:3000] == expected
    assert semi_join(skewed, ids, "null_k", "other", salts=4).count() == skewed.where("null_k = 7").count()


def test_demographics_join_is_inner(spark, rows):
    stays = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "SUBJECT_ID int, s int")
    persons = spark.createDataFrame([(1, "F")], "SUBJECT_ID int, g string")
    assert rows(join_demographics(stays, persons)) == [(1, 10, "F")]


def test_age_band_uses_two_lengths_of_a_year(spark):
    at = date(2100, 1, 1)
    cases = spark.sql(
        "SELECT DATE '2100-01-01' AS at, date_sub(DATE '2100-01-01', d) AS birth, d"
        " FROM VALUES (5475), (5477), (5478), (32870), (32872), (32886), (32887) AS t(d)"
    )
    kept = {r.d for r in filters.filter_age_band(cases, "at", "birth").collect()}
    def age(days, year):
        return round(days / year + 1e-12, 2)

    assert at and kept == {
        d for d in (5475, 5477, 5478, 32870, 32872, 32886, 32887) if age(d, 365.242) >= 15.0 and age(d, 365.424) < 90.0
    }
    # Just past 90 by the first length of a year, still under 90 by the second.
    assert 32872 in kept and age(32872, 365.242) >= 90.0


def test_null_semantics_of_filters(spark, rows):
    df = spark.createDataFrame([(0, "mg"), (1, "Appl"), (None, None), (0, "DROP")], "e int, u string")
    assert rows(filters.filter_equals(df, e=0), "u") == [("DROP",), ("mg",)]
    assert rows(filters.not_equal(df, "u", "Appl", "DROP"), "u") == [("mg",)]
    assert rows(filters.filter_not_null(df, "u"), "u") == [("Appl",), ("DROP",), ("mg",)]
    assert rows(filters.filter_in_list(df, "u", ["mg", "Appl"]), "u") == [("Appl",), ("mg",)]
    assert rows(filters.not_in_literals(df, "u", ["mg"]), "u") == [("Appl",), ("DROP",)]
    assert rows(filters.exclude_any_pattern(df, "u", ["%app%"]), "u") == [("DROP",), ("mg",)]


def test_dictionary_match_is_exact(spark, rows):
    drugs = spark.createDataFrame([("Vancomycin",), ("vancomycin hcl",), ("van",), (None,)], "DRUG string")
    words = spark.createDataFrame([("vancomycin",), ("van",)], "value string")
    assert rows(filters.filter_in_dictionary(drugs, "DRUG", words)) == [("Vancomycin",), ("van",)]
    assert rows(filters.filter_in_dictionary(drugs, "DRUG", words, salts=4)) == [("Vancomycin",), ("van",)]


@pytest.fixture
def eager_skew_splits(spark):
    """Thresholds so low that adaptive execution splits partitions of a small test, and no broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    old = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_adaptive_execution_may_split_what_salts_leave(spark, eager_skew_splits):
    """Also when the small side is an aggregate by the same key, whose partitioning a plain join would take over."""
    hot = spark.range(0, 200000, 1, 24).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v"))
    wide = hot.unionByName(spark.range(0, 2000, 1, 8).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")))
    small = spark.range(0, 2000, 1, 4).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("m"))
    assert "skew=true" in executed(spread_join(wide, small, "k", "left", salts=2).select("v", "m"))


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_key_map_keeps_all_that_occur(spark, rows, bits):
    df = spark.range(20000).select((F.col("id") % 7000).alias("k"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("t"))
    df = df.unionByName(spark.createDataFrame([(None, "t1"), (5, None)], "k long, t string"))
    ids = spark.range(0, 7000, 97).select(F.col("id").alias("k"), F.lit("t1").alias("t"))
    ids = ids.unionByName(spark.createDataFrame([(None, None), (1, None)], "k long, t string"))
    found = key_map(ids, ["k", "t"], bits)
    assert found.count() <= bits >> 15
    kept = in_key_map(df, found, ["k", "t"], bits)
    exact = df.join(ids, ["k", "t"], "left_semi")
    assert kept.columns == df.columns and kept.join(ids, ["k", "t"], "left_semi").count() == exact.count() > 0
    assert kept.count() < 0.05 * df.count()  # bits taken by chance are few
    assert rows(semi_join(df, ids, ["k", "t"], prefilter=True)) == rows(exact)


def test_semi_join_beyond_a_broadcast_shuffles_few_rows(spark, rows):
    """With broadcasting of ids off, what is shuffled for the join is about what the join keeps."""
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("v"))
    ids = spark.range(0, 50_000, 500).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = semi_join(df, ids, "k")
        assert joined.count() == 400
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "bitmap_construct_agg" in plan and "BroadcastHashJoin" in plan and "LeftSemi" in plan
        passed = in_key_map(df, key_map(ids, ["k"]), ["k"]).count()
        assert 400 <= passed < 440  # of 200,000 rows
        assert rows(joined) == rows(semi_join(df, ids, "k", prefilter=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
