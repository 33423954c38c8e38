import random

import public_tokenizers
import pytest
from cohortspark.llm.token_counts import LIMIT, VOCABULARY, Counter, count_tokens, op1_token_counts, read_tokenizer
from helpers import awkward_texts, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(read_tokenizer(PATH), public_tokenizers.PATTERN)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert COUNTER.tokens(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sé 1\n\t .日", max_size=80), st.integers(1, 20))
def test_chunks_compose_like_the_whole(text, size):
    parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    assert COUNTER.total([COUNTER.map_of(p) for p in parts]) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "a", "1", "|", "<|end", "oftext|>", " ", "é", "'s", "日本"]), max_size=25), st.integers(1, 30))
def test_chunks_cut_inside_special_strings(parts, size):
    text = "".join(parts)
    chunks = [text[i : i + size] for i in range(0, len(text), size)] or [""]
    assert COUNTER.total([COUNTER.map_of(c) for c in chunks]) == library(text)


def test_texts_without_white_space_are_settled_inside_chunks():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh0123456789+/") for _ in range(20000))
    maps = [COUNTER.map_of(text[i : i + 1000]) for i in range(0, len(text), 1000)]
    assert all(settled and len(head) + len(tail) < 200 for settled, head, _, tail in maps)
    assert COUNTER.total(maps) == library(text)


def test_rows_from_any_plan(spark):
    """Rows that were shuffled, joined or sorted before keep their own counts."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcé1,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    docs = documents(spark, texts).repartition(5)
    want = [(i, library(t)) for i, t in enumerate(texts)]
    other = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("third"))
    for made in (docs.repartition(7), docs.join(other, "doc_id"), docs.orderBy("text"), docs.repartition(4, "n_chars").distinct()):
        rows = count_tokens(made, PATH, public_tokenizers.PATTERN, chunk_chars=40).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in rows) == want


def test_special_strings_count_once():
    text = "a<|endoftext|>b <|endoftext|>"
    assert COUNTER.tokens(text) == library(text)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 16])
def test_documents(spark, chunk):
    docs = clashing(documents(spark, awkward_texts()))
    rows = count_tokens(docs, PATH, public_tokenizers.PATTERN, chunk_chars=chunk).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(i, library(t)) for i, t in enumerate(awkward_texts())]
    assert set(rows[0].asDict()) == set(docs.columns)


def test_repeated_rows_and_no_rows(spark):
    docs = documents(spark, ["twice told " * 30])
    assert count_tokens(docs.union(docs), PATH, public_tokenizers.PATTERN, chunk_chars=50).count() == 2
    assert count_tokens(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, tmp_path):
    texts = awkward_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_token_counts(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > LIMIT)


def test_full_tables_are_recompiled(monkeypatch):
    from cohortspark.llm import token_counts

    monkeypatch.setattr(token_counts, "MOST_TRANSITIONS", 50)
    monkeypatch.setattr(token_counts, "MOST_COUNTED", 5)
    counter, rng = Counter(read_tokenizer(PATH), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(100):
        text = " ".join("".join(rng.choice("thearn") for _ in range(8)) for _ in range(5))
        assert counter.tokens(text) == library(text)
