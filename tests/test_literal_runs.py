import random
import re

import pyarrow as pa
import pytest

from cohortspark.operators import literal_runs, pattern_table
from cohortspark.operators.literal_runs import Search, like, runs_of
from cohortspark.operators.pattern_table import exclude_any_of, match_any_of, matched_patterns

TEXTS = ["red bolt one", "Red Bolt", "a blue nut", "a blue nut\n", "xxéàüöxx", "", None, "plain", "red bolt one"]
PATTERNS = ["%red bolt%", "%blue nut%", "%blue nut", "%éàü%", "%lai%", "%o_t%", "_%"]


def table(spark, patterns):
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def matches(text, pattern):
    """LIKE without escapes, by a regular expression."""
    return re.fullmatch(re.escape(pattern).replace("%", ".*").replace("_", "."), text, re.S) is not None


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def wanted(patterns):
    return {i: None if t is None else sorted(p for p in patterns if matches(t.lower(), p)) for i, t in enumerate(TEXTS)}


def test_no_text_is_shuffled(spark, docs):
    """Neither a join nor an exchange, however small a broadcast may be: disk holds nothing of the texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = exclude_any_of(docs, "text", table(spark, PATTERNS))
        plan = none._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert {r.id for r in none.collect()} == {i for i, p in wanted(PATTERNS).items() if p == []}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.mark.parametrize("most", [1, 7])
def test_a_table_of_patterns_in_parts(spark, docs, monkeypatch, most):
    monkeypatch.setattr(pattern_table, "MOST_RUNS", most)
    got = matched_patterns(docs, "text", table(spark, PATTERNS))
    assert got.columns == ["id", "text", "patterns"]
    assert {r.id: r.patterns for r in got.collect()} == wanted(PATTERNS)
    assert {r.id for r in match_any_of(docs, "text", table(spark, ["%bolt%", "%blue%"])).collect()} == {0, 1, 2, 3, 8}


def test_a_pattern_that_ends_in_a_line_break(spark, docs):
    """It is not the literal between two % that it begins with."""
    got = matched_patterns(docs, "text", table(spark, ["%nut%\n", "%nut%"]))
    assert {r.id: r.patterns for r in got.collect() if r.patterns} == {2: ["%nut%"], 3: ["%nut%", "%nut%\n"]}


def runs(patterns):
    """What pattern_grams gives, without Spark."""
    rows = []
    for p in patterns:
        parts = re.findall(r"[^%_]+", p)
        found = [(n, {x[i : i + n] for x in parts for i in range(len(x) - n + 1)}) for n in (6, 3, 2, 1)]
        n, of = next(((n, of) for n, of in found if of), (0, {""}))
        rows += [(p.encode(), x.encode(), n) for x in sorted(of)]
    return runs_of(pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["pattern", "gram", "n"]))


@pytest.mark.parametrize("window, most", [(1 << 17, 1 << 20), (64, 5), (3, 1), (1, 1 << 20)])
@pytest.mark.parametrize("letters", ["ab", "aé🙂\0", "abcdefg "])
def test_literals_are_found_wherever_they_stand(monkeypatch, window, most, letters):
    """On the borders of windows and texts, as parts of each other, and after runs have been chosen anew."""
    monkeypatch.setattr(literal_runs, "WINDOW", window)
    monkeypatch.setattr(literal_runs, "MOST_PAIRS", most)
    rng = random.Random(window)

    def word(longest):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))

    for _ in range(10):
        patterns = {rng.choice(["%{}%", "%{}%", "{}%", "%{}_%", "%{}%{}%", "%{}_{}", "{}"]).format(word(12), word(9)) for _ in range(25)}
        texts = [None, "", *[word(50) for _ in range(20)]]
        search = Search(runs(patterns))
        for kind in (pa.string(), pa.large_string()):
            got = search(pa.array(["left out", *texts, "x"], kind).slice(1, len(texts))).to_pylist()
            for text, pairs in zip(texts, got, strict=True):
                assert pairs == {"found": sorted(p for p in patterns if matches(text or "", p)), "likely": []}


def test_texts_are_searched_once(spark, docs):
    """A filter on the matches does not search again, no text is exploded, and the text itself goes no further than the search."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = match_any_of(docs, "text", table(spark, PATTERNS)).select("id")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Generate" not in plan and "Exchange" not in plan
        assert {r.id for r in some.collect()} == {i for i, p in wanted(PATTERNS).items() if p}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_like_goes_back_for_no_part():
    """Two parts that a long text holds everywhere, and no end: a search that goes back needs hours."""
    text = "ab" * 100_000
    assert not like(b"%a_a%b_b%a_a%b_b%a_c%")(text.encode()) and not like(b"%ab%_s")(text.encode())
    assert like(b"%a_a%b_b%a_a%b_b%")(text.encode()) and like(b"_b%ab%b_b")(text.encode())


def test_like_is_like():
    rng = random.Random(5)
    for _ in range(4000):
        pattern, text = ("".join(rng.choice(x) for _ in range(rng.randint(0, n))) for x, n in (("aé🙂_%", 7), ("aé🙂\n", 8)))
        assert like(pattern.encode())(text.encode()) == matches(text, pattern), (pattern, text)
