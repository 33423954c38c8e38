import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators.pattern_table import exclude_any_of, match_any_of, matched_patterns, pattern_grams

PATTERNS = ["%abc%", "%bca%cab%", "a_c%", "%ab", "%ab%", "%c%", "_", "__", "", "%\\_%", "%ABC%", "%zzz%", "%é🙂a%", "%_", "abcabcab", None, "%abc%"]


def like(text, pattern):
    """SQL's LIKE, character by character."""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    if pattern[0] == "\\":
        return bool(text) and text[0] == pattern[1] and like(text[1:], pattern[2:])
    return bool(text) and pattern[0] in (text[0], "_") and like(text[1:], pattern[1:])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcABC _é🙂") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    return [*made, None, "", "x", "é🙂a", "abcabcab", "same abc", "same abc"]


@pytest.mark.parametrize("patterns", [PATTERNS, ["%abc%", "%bca%cab%"], ["%ab%", "%abc%"], ["%c%"], [None], []])
def test_patterns_match_like_like(spark, texts, patterns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("patterns_of", F.lit("kept"))
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {i: None if t is None else sorted({p for p in patterns if p is not None and like(t.lower(), p)}) for i, t in enumerate(texts)}
    got = matched_patterns(df, "text", table)
    assert got.columns == [*df.columns, "patterns"]
    assert {r.id: r.patterns for r in got.collect()} == want
    assert {r.id for r in match_any_of(df, "text", table).collect()} == {i for i, m in want.items() if m}
    assert {r.id for r in exclude_any_of(df, "text", table).collect()} == {i for i, m in want.items() if m == []}


def test_without_lower_case(spark):
    df = spark.createDataFrame([(1, "ABC"), (2, "abc")], "id long, text string")
    table = spark.createDataFrame([("%ABC%",)], "pattern string")
    assert [r.id for r in match_any_of(df, "text", table, lower=False).collect()] == [1]
    assert match_any_of(df, "text", table).count() == 0


def test_runs_of_characters(spark, rows):
    table = spark.createDataFrame([("%abcd%xy",), ("%xy%",), ("%",), ("_%",)], "p string")
    assert rows(pattern_grams(table, "p")) == [("%", ""), ("%abcd%xy", "abc"), ("%abcd%xy", "bcd"), ("%xy%", "xy"), ("_%", "")]


def test_no_pattern_is_tested_on_every_text(spark):
    """Neither a nested-loop nor a cartesian join, and texts that hold no pattern's rarest run meet no pattern."""
    df = spark.range(2000).select("id", F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    table = spark.range(1000).select(F.concat(F.lit("%er "), (F.col("id") + 500).cast("string"), F.lit("%")).alias("pattern"))
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = match_any_of(df, "text", table)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert found.count() == sum(any(str(i).startswith(str(n)) for n in range(500, 1500)) for i in range(2000))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
