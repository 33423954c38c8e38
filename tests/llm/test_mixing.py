import re
from collections import Counter, defaultdict

import pytest
from cohortspark.llm import mixing
from cohortspark.llm.mixing import copies, mix_documents, op10_source_mixing, rounded, rows_to_mix, source_targets, with_copies
from helpers import awkward_texts, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """{source: target} of {source: size}, sources by code point, None last."""
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in full]
        each = (total - sum(full.values())) / (sum(weight[n] for n in rest) or 1)
        above = [n for n in rest if weight[n] * each > 3 * sizes[n]]
        if not above:
            return {**full, **{n: weight[n] * each for n in rest}}
        full.update({n: 3.0 * sizes[n] for n in above})


def corpus(spark, n=3000, sources=("b", "a", None, "Z", "é", "tiny")):
    texts = [" ".join(["w"] * (1 + (i * 7919) % 97 * (1 + i % 5 == 0) * 3)) for i in range(n)]
    held = [sources[-1] if i < 3 else sources[0] if i % 3 else sources[i // 3 % (len(sources) - 1)] for i in range(n)]
    return documents(spark, texts + awkward_texts(), held + ["b"] * len(awkward_texts()))


def test_targets(spark):
    sizes = {"b": 100, "a": 10, None: 1, "Z": 1000, "é": 0, "c": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in source_targets(df).collect()}
    assert got == {n: (sizes[n], pytest.approx(t)) for n, t in plain_targets(sizes).items()}


@pytest.mark.parametrize("bucket, set_aside", [(128, 256), (4, 3)])
def test_words_come_near_the_target(spark, monkeypatch, bucket, set_aside):
    monkeypatch.setattr(mixing.rounded, "__defaults__", (0, bucket, set_aside))
    docs = clashing(corpus(spark)).repartition(5)
    rows = rows_to_mix(docs)
    mixed = with_copies(rows, *copies(rows)).collect()
    size, taken, longest = Counter(), Counter(), Counter()
    for r in mixed:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.copies <= 3
    targets = plain_targets(size)
    for r in mixed:
        assert r.source_size == size[r.source] and r.target == pytest.approx(targets[r.source])
        rate = r.target / r.source_size
        assert rate - 1 < r.copies < rate + 1
    for source, target in targets.items():
        assert abs(taken[source] - target) <= longest[source]
    again = with_copies(rows.repartition(3), *copies(rows.repartition(2))).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in mixed)


def test_each_document_keeps_its_chance(spark):
    """Over many sources with the same documents each is taken as often as its fraction says, and words stay near."""
    words = [1, 2, 3, 5, 8, 13, 40, 7, 7, 9, 60]
    units = spark.createDataFrame([(g * 100 + i, g, float(w), 0.3) for g in range(400) for i, w in enumerate(words)], "unit long, key long, words double, part double")
    taken, mixed = defaultdict(int), defaultdict(float)
    for r in rounded(units).collect():
        taken[r.unit % 100] += r.extra
        mixed[r.unit // 100] += r.extra * words[r.unit % 100]
    assert all(abs(n / 400 - 0.3) < 0.1 for n in taken.values())
    assert all(abs(m - 0.3 * sum(words)) <= 60 for m in mixed.values())


def test_documents_are_repeated_or_go(spark):
    docs = clashing(corpus(spark, 300))
    out = mix_documents(docs)
    assert out.columns == docs.columns
    rows = rows_to_mix(docs)
    expected = Counter({r.doc_id: r.copies for r in with_copies(rows, *copies(rows)).collect()})
    assert Counter(r.doc_id for r in out.collect()) == +expected


def test_repeated_rows_nulls_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None), (1, "a b c", "s"), (1, "a b c", "s"), (2, None, "t")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = op10_source_mixing(spark, f"{tmp_path}/a").collect()
    assert len(rows) == 4 and len({r.taken for r in rows if r.doc_id == 1}) == 1
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op10_source_mixing(spark, f"{tmp_path}/b").count() == 0
    assert mix_documents(docs.limit(0)).count() == 0


def test_no_python_runs_on_executors(spark):
    rows = rows_to_mix(documents(spark, ["a b"], ["s"]))
    plan = with_copies(rows, *copies(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
