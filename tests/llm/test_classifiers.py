import random
import zlib

import numpy as np
import pytest
from cohortspark.llm import quality, toxicity
from cohortspark.llm.labelled import fold_of, labelled_sample
from helpers import awkward_texts, clashing, documents
from pyspark.sql import functions as F

BAD = ("vile", "rotten", "nasty")


def words(rng, n):
    return ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic documents hold a bad word, junk is made of symbols; groups are named in toxic documents most."""
    rng, texts, labels = random.Random(2), [], []
    for i in range(900):
        text, toxic, good = words(rng, rng.randint(5, 400)), i % 4 == 0, i % 5 != 1
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        if rng.random() < (0.9 if toxic else 0.1):
            text.insert(0, rng.choice(["women", "muslims", "gay"]))
        if not good:
            text = [w + rng.choice(["%%%", "$$$", "&&&", " |"]) for w in text]
        texts.append(" ".join(text))
        labels.append((i, int(good), int(toxic)))
    texts += awkward_texts()
    folder = str(tmp_path_factory.mktemp("labelled"))
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    more = [(5, None, None), (None, 1, 1), (0, 1, 1)]
    spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, {i: (g, t) for i, g, t in labels}


@pytest.mark.parametrize("module, query, column, folds, held", [(toxicity, "op8_toxicity", 1, 3, 1), (quality, "op6_quality", 0, 4, 2)])
def test_held_out_accuracy(spark, corpus, module, query, column, folds, held):
    folder, texts, labels = corpus
    rows = getattr(module, query)(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id][column])
    assert len(right) > 100 and np.mean(right) > 0.97


def test_held_out_labels_are_never_read(spark, corpus):
    folder, _, _ = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(fold_of(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels, per_class=100) == toxicity.fit_toxicity(docs, other, per_class=100)


def test_group_names_alone_are_not_toxic(spark, corpus):
    folder, _, _ = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit_toxicity(docs, labels))
    neutral = [scorer.score(f"{name} sat in a row") for name in ("women", "muslims", "gay")]
    assert max(neutral) < 0.5 and max(neutral) - min(neutral) < 0.2
    assert all(scorer.score(f"{name} so vile") > 0.7 for name in ("women", "muslims", "gay"))


def test_swaps_are_those_of_whole_sentences():
    """The features that go and come are the differences of two whole sentences."""
    rng = random.Random(9)
    place = {t: i for i, t in enumerate(toxicity.IDENTITY_TERMS)}
    names, mentions = list(place), 0
    for _ in range(300):
        words = rng.choices([*names, "womenfolk", "old,", "(men)", "=man", "the", "whites"], k=rng.randint(1, 8))
        got, want = list(toxicity.swapped(" ".join(words), place)), []
        for i, word in enumerate(words):
            at = place.get(word.strip(toxicity.STRIPPED))
            if at is not None:
                for k in range(1, toxicity.SWAPS + 1):
                    put = " ".join([*words[:i], names[(at + k * 7) % len(names)], *words[i + 1 :]])
                    own, other = toxicity.text_features(" ".join(words)), toxicity.text_features(put)
                    want.append((at, own - other, other - own))
        assert [(term, set(gone), set(come)) for term, gone, come in got] == want
        mentions += len(want)
    assert mentions > 1000


def test_many_mentions_of_one_group_leave_the_penalty_of_others(spark, monkeypatch):
    """Whatever the order of the documents, each group that is mentioned has its swaps in the fit."""
    rng, names, fitted = random.Random(4), toxicity.IDENTITY_TERMS, []

    def fit(*given):
        fitted.append(given)
        return np.zeros(given[0].shape[1] + 1)

    monkeypatch.setattr(toxicity, "fit", fit)
    texts = [" ".join([names[i % len(names)], *words(rng, 9)]) + "." + " men sat." * 300 for i in range(120)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    features = list(toxicity.fit_toxicity(docs, labels)[0])
    seen = {names[i % len(names)] for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(seen) > 30
    change = fitted[0][3]
    assert {name for name in names if (change[:, features.index(f"={name}")] > 0).any()} == seen
    toxicity.fit_toxicity(docs.orderBy(F.desc("doc_id")), labels)
    assert all(np.array_equal(a, b) for a, b in zip(*fitted, strict=True))


def test_samples_are_bounded_and_weighted(spark, corpus):
    folder, _, _ = corpus
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled_sample(docs, labels, "toxic", 3, 1, 50).collect()
    for label in (0, 1):
        got = [r.weight for r in rows if r.label == label]
        every = sum(1 for i, (_, t) in corpus[2].items() if t == label and zlib.crc32(str(i).encode()) % 3 != 1)
        assert 25 < len(got) < 90 and abs(sum(got) - every) < 0.5 * every


def test_long_documents_are_learned_from(spark, monkeypatch):
    """The bound on passages drops documents by chance, not the long ones, and neither label."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, 5000) if i % 4 == 0 else [w + "$$$" for w in words(rng, 40)]) for i in range(320)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(320)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "MOST_PASSAGES", 160)
    model = quality.fit_quality(docs, labels)
    assert model.score([texts[0].encode()])[0] > 0.7 and model.score([texts[1].encode()])[0] < 0.5
    sample = labelled_sample(docs, labels, "quality", 4, 2, 4000)
    every, kept = (df.select("label", "weight", F.octet_length("text").alias("n")).collect() for df in (sample, quality.within(sample, 160)))
    assert sum(-(-r.n // quality.PASSAGE) for r in kept) <= 160
    for label in (0, 1):
        assert sum(r.weight for r in kept if r.label == label) == pytest.approx(sum(r.weight for r in every if r.label == label))
    assert quality.within(sample, 10**6) is sample


@pytest.mark.parametrize("fit, score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_no_labels_no_rows_and_extra_columns(spark, fit, score):
    docs = clashing(documents(spark, awkward_texts()))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        scored = score(docs, fit(docs, labels))
        rows = scored.collect()
        assert len(rows) == len(awkward_texts()) and all(0 <= r.score <= 1 for r in rows)
        assert set(scored.columns) == set(docs.columns)
    assert score(docs.limit(0), fit(docs.limit(0), one)).count() == 0


def test_attention_slopes():
    """The slopes of the loss are those that small changes of the weights show."""
    x, first = quality.passages([b"abc def " * 400, b"", b"a$$$ | b%%%", "é! " .encode() * 900])
    model = quality.Attention(3)
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.1, 0.4, 0.3, 0.2])

    def loss():
        p = model.forward(x, first)["score"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    state = model.forward(x, first)
    slopes = model.slopes(first, state, weight * (state["score"] - y))
    for name, w in model.weights.items():
        at = tuple(n // 2 for n in w.shape)
        w[at] += 1e-5
        above = loss()
        w[at] -= 2e-5
        below = loss()
        w[at] += 1e-5
        assert (above - below) / 2e-5 == pytest.approx(slopes[name][at], rel=1e-3, abs=1e-7)
