import random
import re
from itertools import combinations

import pytest
from cohortspark.llm import jaccard_join
from cohortspark.llm.jaccard_join import keep_one_of_each, least_occurrences, occurrences, op5_jaccard_join, required, similar_documents, t_occurrence
from helpers import awkward_texts, clashing, documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(texts):
    """{row: (size, smallest reachable row)}"""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts(seed, groups=12, most=12):
    """Groups that differ by some words, chains that drift, documents that share a passage, and awkward texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = awkward_texts()
    for _ in range(groups):
        words = [word() for _ in range(rng.randint(6, 120))]
        drift = rng.random() < 0.5
        for _ in range(rng.randint(1, most)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy = copy[: max(5, int(len(copy) * rng.uniform(0.7, 1)))]
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
            if drift:
                words = copy
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 15))]) for _ in range(15)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, bucket, long, frequent", [(1, 1_000_000, 64, 256), (2, 300, 3, 4), (3, 1000, 2, 2)])
def test_components(spark, monkeypatch, seed, bucket, long, frequent):
    """Also with limits so low that long lists, frequent shingles and many buckets occur."""
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    texts = near_texts(seed)
    found = similar_documents(clashing(documents(spark, texts)).repartition(3), bucket=bucket).collect()
    assert {r.id: (r.n, r.component) for r in found} == plain(texts)


@pytest.mark.parametrize("parts", [1, 4])
def test_buckets_beyond_the_first_shuffle(spark, parts):
    """Buckets are split once more by further bits of the hash."""
    texts = near_texts(5)
    found = similar_documents(documents(spark, texts).repartition(4), bucket=150, parts=parts).collect()
    assert {r.id: (r.n, r.component) for r in found} == plain(texts)


def test_partners_share_that_many_of_the_merged_lists():
    """Of sets in one order of their elements, the parts that are merged have at least t in common if the sets are similar."""
    rng = random.Random(3)
    similar = 0
    for _ in range(4000):
        a = set(rng.sample(range(60), rng.randint(1, 40)))
        b = {x for x in a if rng.random() < 0.93} | set(rng.sample(range(60), rng.randint(0, 3)))
        if b and 100 * len(a & b) >= 75 * len(a | b):
            similar += 1
            merged = [set(sorted(x)[: len(x) - required(len(x)) + occurrences(len(x))]) for x in (a, b)]
            assert len(merged[0] & merged[1]) >= max(least_occurrences(len(a)), least_occurrences(len(b)))
    assert similar > 1000 and least_occurrences(100) == jaccard_join.OCCURRENCES > 1 == least_occurrences(1)


def test_same_id_with_other_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "x y z"), (3, "x y z"), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(docs).collect()) == [(1, "a b c d e f"), (2, "a b c d e f"), (2, "x y z"), (3, ""), (3, "x y z")]


def test_one_of_each_stays(spark):
    texts = near_texts(4)
    docs = clashing(documents(spark, texts))
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in plain(texts).items() if c == i)


def test_repeated_rows_missing_ids_and_no_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "", None])
    again = docs.union(docs)
    assert sorted((r.id, r.component) for r in similar_documents(again).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2), (3, 3), (3, 3)]
    assert sorted(r.doc_id for r in keep_one_of_each(again).collect()) == [0, 2, 2, 3, 3]
    unnamed = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert [r.component for r in similar_documents(unnamed).collect()] == [None, None]
    assert keep_one_of_each(unnamed).count() == 2
    assert similar_documents(docs.limit(0)).count() == 0
    assert keep_one_of_each(docs.limit(0)).count() == 0


def test_occurrences():
    lists = [[1, 3, 5], [1, 5, 9], [5]]
    assert list(t_occurrence(lists, 1)) == [1, 3, 5, 9]
    assert list(t_occurrence(lists, 2)) == [1, 5]
    assert list(t_occurrence(lists, 3)) == [5]
    assert list(t_occurrence([], 1)) == []


def test_query(spark, tmp_path):
    texts = near_texts(7, groups=4)
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = op5_jaccard_join(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain(texts)
