"""Every stage of the pipeline, and the chain, against plain Python on a small folder with awkward rows."""

import base64
import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from cohortspark.llm.toxicity import TOXIC, fit_toxicity, score_toxicity
from helpers import awkward_texts, clashing, documents
from pyspark.sql import functions as F
from test_jaccard_join import plain as plain_groups
from test_line_dedup import plain as plain_lines
from test_mixing import WORD, plain_targets

EXTRA = ["dotted.name", "Copies"]


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioustrnm") for _ in range(rng.randint(2, 8)))
    texts = []
    for i in range(260):
        words = [word() for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten"]))
        texts.append(" ".join(words[:5]) + "\n" + " ".join(words[5:]))
    for _ in range(40):  # exact copies, near copies and shared lines
        words = rng.choice(texts[:260]).split(" ")
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return texts + awkward_texts() + ["a shared line of text\n" + t for t in ("x y", "z", "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = corpus()
    sources = [(None, "web", "books", "web")[i % 4] for i in range(len(texts))]
    docs = clashing(documents(spark, texts, sources)).withColumn(EXTRA[0], F.lit("kept")).withColumn(EXTRA[1], F.col("doc_id"))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.union(docs.limit(2)).write.parquet(f"{path}/documents.parquet")  # two rows twice
    labels = [(i, 1, int("vile" in t or "rotten" in t)) for i, t in enumerate(texts[:260])] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stored(spark, folder):
    """What each stage got, as stored, and returned."""
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.durable(stage(spark, docs, folder))
        seen.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in seen}


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(stored):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "encoding"]
    for name, (before, after) in stored.items():
        if name != "encoding":
            assert after.columns == before.columns
            assert after.select(F.col(f"`{EXTRA[0]}`")).distinct().count() == 1


def test_toxic_documents_go(spark, stored, folder):
    before, after = stored["toxicity"]
    model = fit_toxicity(before, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score_toxicity(before.select("doc_id", "text"), model)
    want = Counter((r.doc_id, r.text) for r in scored.collect() if r.score < TOXIC)
    assert Counter(rows(after)) == want
    gone = Counter(rows(before)) - want
    assert gone and all("vile" in t or "rotten" in t for _, t in gone)
    clean = [x for x in rows(before) if not x[1] or not ("vile" in x[1] or "rotten" in x[1])]
    assert not Counter(clean) - want


def test_shared_lines_stay_once(stored):
    before, after = stored["line_dedup"]
    held = rows(before)
    assert sorted(rows(after)) == sorted(plain_lines(held))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(stored):
    before, after = stored["jaccard_join"]
    held = sorted(rows(before), key=lambda r: r[0])
    groups = plain_groups([t for _, t in held])
    first = {}
    for place, (doc, text) in enumerate(held):
        size, root = groups[place]
        if size:
            first.setdefault(root, (doc, text))
    want = sorted([x for place, x in enumerate(held) if not groups[place][0]] + list(first.values()))
    assert sorted(set(rows(after))) == sorted(set(want))
    assert len(first) < sum(1 for place in range(len(held)) if groups[place][0])


def test_mix_comes_near_its_targets(stored):
    before, after = stored["mixing"]
    size, longest = Counter(), Counter()
    for r in before.collect():
        n = len(WORD.findall(r.text or ""))
        size[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    targets, taken, times = plain_targets(size), Counter(), Counter()
    known = set(rows(before))
    for r in after.collect():
        assert (r.doc_id, r.text) in known
        taken[r.source] += len(WORD.findall(r.text or ""))
        times[r.doc_id] += 1
    assert all(abs(taken[s] - t) <= longest[s] for s, t in targets.items()) and max(times.values()) <= 6  # two rows are there twice


def test_ids_are_the_librarys(stored):
    before, after = stored["encoding"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((d, tuple(library.encode_ordinary(t or ""))) for d, t in rows(before))
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want
    for r in after.collect():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == r.text_sha256


def test_run_gives_what_the_stages_give(spark, folder, stored):
    got = Counter((r.doc_id, r.text_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter((r.doc_id, r.text_sha256, tuple(r.ids)) for r in stored["encoding"][1].collect())
    assert hashlib.sha256(b"").hexdigest()


def test_empty_tables_and_missing_labels(spark, folder, tmp_path):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for name, kept_docs, kept_labels in (("none", docs.limit(0), labels.limit(0)), ("unlabelled", docs.limit(20), labels.limit(0))):
        path = str(tmp_path / name)
        kept_docs.write.parquet(f"{path}/documents.parquet")
        kept_labels.write.parquet(f"{path}/labels.parquet")
        made = corpus_pipeline.run(spark, path)
        assert set(made.columns) >= {"doc_id", "ids", "n_tokens"} and (made.count() == 0) == (name == "none")
