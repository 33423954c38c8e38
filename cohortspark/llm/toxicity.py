"""A toxicity classifier that identity terms alone don't move.

A document's features are which words and word beginnings it has, whatever their number and place, so the score of a
long document doesn't depend on its length. Features are selected by how much more often toxic documents of the sample
have them. The classifier is a logistic regression with a counterfactual penalty: in labelled sentences that name a
group, the term is swapped for the terms of other groups, and the squared change of the score (before the logistic
function) is part of the loss. So a group's name adds nothing by itself, and neutral mentions aren't rejected. Every
mention of the sample counts, with its document's weight. Each term that is mentioned has the same part of the penalty,
so that a term with very many mentions doesn't use up that of the others.

The fit is made on a bounded sample of labelled documents (``PER_CLASS`` for each label). Their feature counts and the
swaps, of which only a bounded number differ, come from distributed aggregations; every document is scored whole.

Defined results: null and empty texts have no features and get the intercept's score; a document without id is scored
and not held out; without labels of both kinds every score is the share of toxic labels (0 without labels); repeated
rows get the same score; further columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import once, table, text_of
from cohortspark.llm.labelled import fold_of, labelled_sample
from cohortspark.llm.registry import query

#: Labelled documents of each kind to fit on, features to select, documents that a feature is in at least.
PER_CLASS, FEATURES, LEAST_DOCS = 4000, 1024, 4

#: Lengths of word beginnings.
BEGINNINGS = range(3, 8)

#: Swaps of a mention, weight of the penalty.
SWAPS, PENALTY = 4, 10.0

#: Shrinks the intercept. Most clean documents have no feature at all; without this their score would go on falling
#: and a single toxic word would not make up for it.
INTERCEPT_DECAY = 1e-2

#: From this score on a document is toxic. The held-out fold of labels, of how many.
TOXIC, FOLDS, HELD_OUT = 0.7, 3, 1

#: Names of groups that a text may mention neutrally; a parameter.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "gay", "lesbian", "bisexual",
    "straight", "queer", "black", "white", "asian", "african", "european", "american", "latino", "arab", "jewish",
    "jews", "muslim", "muslims", "christian", "christians", "catholic", "hindu", "buddhist", "atheist", "immigrants",
    "refugees", "disabled", "deaf", "blind", "elderly", "young", "old",
)

#: Words that a task remembers the features of.
KEPT = 300_000

STRIPPED = ".,;:!?\"'()[]{}|*%$&#-"
SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    """A word without punctuation around it, and its beginnings."""
    word = word.strip(STRIPPED)
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)] if word else []


def text_features(text: str) -> set[str]:
    return {f for word in set(text.lower().split()) for f in word_features(word)}


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): weightless numbers of sampled documents with each feature, combined in the map tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                counts[label > 0].update(text_features(text.as_py()))
        names = list(counts[0] | counts[1])
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict(
                {"feature": part, "toxic": [counts[1][f] for f in part], "clean": [counts[0][f] for f in part]}
            )

    partial = sample.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long")
    return partial.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def select_features(sample: DataFrame, toxic: int, clean: int, terms: Iterable[str]) -> list[str]:
    """The features whose share among toxic documents exceeds that among clean ones most surely, and the terms."""
    there, elsewhere = F.col("toxic") / toxic, F.col("clean") / clean
    both = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    sure = (there - elsewhere) / F.sqrt(both * (1 - both + 1e-9))
    counted = feature_counts(sample).where((F.col("toxic") >= LEAST_DOCS) & (there > 2 * elsewhere))
    best = counted.orderBy(sure.desc(), "feature").limit(FEATURES).collect()  # a bounded number
    return list(dict.fromkeys([r["feature"] for r in best] + [f for t in terms for f in word_features(t)]))


def swapped(text: str, terms: dict[str, int]) -> Iterator[tuple[int, list[str], list[str]]]:
    """For each mention of a group and each other name in its place: the term's number, features that go and that come."""
    names = list(terms)
    of_term = [word_features(name) for name in names]
    watched = {f for features in of_term for f in features}
    for sentence in SENTENCE.findall(text.lower()):
        words = sentence.split()
        places = [place for word in words if (place := terms.get(word.strip(STRIPPED))) is not None]
        if places:
            held = Counter(f for word in words for f in word_features(word) if f in watched)
            for place in places:
                own = of_term[place]
                for k in range(1, SWAPS + 1):
                    other = of_term[(place + k * 7) % len(names)]
                    # another word of the sentence may have a feature as well
                    gone = [f for f in own if held[f] == 1 and f not in other]
                    yield place, gone, [f for f in other if held[f] == 0]


def sample_rows(sample: DataFrame, features: list[str]) -> list:
    """For each sampled document its label, weight and feature numbers, in an order of their own. A bounded number."""
    number = {f: i for i, f in enumerate(features)}
    kinds = pa.schema([("label", pa.int32()), ("weight", pa.float64()), ("has", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label, weight in zip(*(c.to_pylist() for c in batch.columns)):
                has = sorted(number[f] for f in text_features(text) if f in number)
                rows.append({"label": label, "weight": weight, "has": has})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    made = sample.select("text", "label", "weight").mapInArrow(run, "label int, weight double, has array<int>")
    return sorted(made.collect(), key=lambda r: (r["label"], r["has"], r["weight"]))


def sample_swaps(sample: DataFrame, features: list[str], terms: Iterable[str]) -> list:
    """(term, gone, come, weight): the different swaps of all mentions, by feature numbers, and what each weighs.

    Word beginnings are nested, so a pair of terms has at most a few dozen different swaps, whatever the documents. Sums
    are decimal, which no order of addition changes.
    """
    number = {f: i for i, f in enumerate(features)}
    place = {t: i for i, t in enumerate(terms)}
    kinds = pa.schema([("term", pa.int32()), ("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("n", pa.int64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, weight in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter((term, *(tuple(sorted(number[f] for f in x if f in number)) for x in (gone, come))) for term, gone, come in swapped(text, place))
                if found:
                    rows = [{"term": term, "gone": gone, "come": come, "n": n, "weight": weight} for (term, gone, come), n in found.items()]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    made = sample.select("text", "weight").mapInArrow(run, "term int, gone array<int>, come array<int>, n long, weight double")
    weight = F.sum(F.col("weight").cast("decimal(18,6)") * F.col("n")).cast("double").alias("weight")
    return sorted(made.groupBy("term", "gone", "come").agg(weight).collect())


def swap_shares(swaps: list) -> np.ndarray:
    """The part of the penalty that each swap has: equal parts for the terms, by weight within a term."""
    total = Counter()
    for row in swaps:
        total[row["term"]] += row["weight"]
    return np.array([row["weight"] / total[row["term"]] / len(total) for row in swaps])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, share: np.ndarray, rounds: int = 1000, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the intercept) of least logistic loss with counterfactual penalty, by Adam.

    ``share`` is the part of the penalty that each row of ``change`` has.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    change = np.hstack([change, np.zeros((len(change), 1), x.dtype)])
    share = share.astype(x.dtype)
    weight = weight / weight.sum()
    shrunk = np.full(x.shape[1], decay)
    shrunk[-1] = INTERCEPT_DECAY
    w, mean, square = np.zeros(x.shape[1]), 0.0, 0.0
    w[-1] = math.log(max(1e-6, weight @ y) / max(1e-6, 1 - weight @ y))
    for i in range(1, rounds + 1):
        single = w.astype(x.dtype)
        p = 1 / (1 + np.exp(-np.clip((x @ single).astype(float), -30, 30)))
        slope = x.T @ (weight * (p - y)).astype(x.dtype) + shrunk * w
        if len(change):
            slope += 2 * PENALTY * (change.T @ (share * (change @ single)))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-9)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", terms: Iterable[str] = IDENTITY_TERMS, per_class: int = PER_CLASS) -> tuple[dict[str, float], float]:
    """(weight of each feature, intercept)."""
    terms = list(dict.fromkeys(terms))
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, per_class)
    counts = {bool(r["toxic"]): (r["n"], r["weight"]) for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
    if len(counts) < 2:
        return {}, 30.0 if True in counts else -30.0
    features = select_features(sample, counts[True][0], counts[False][0], terms)
    rows, swaps = sample_rows(sample, features), sample_swaps(sample, features, terms)
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        x[i, row["has"]] = 1
    change = np.zeros((len(swaps), len(features)), np.float32)
    for i, row in enumerate(swaps):
        change[i, row["gone"]] += 1
        change[i, row["come"]] -= 1
    y, weight = np.array([r["label"] > 0 for r in rows], float), np.array([r["weight"] for r in rows])
    w = fit(x, y, weight, change, swap_shares(swaps))
    return dict(zip(features, w[:-1].tolist())), float(w[-1])


class Scorer:
    def __init__(self, model: tuple[dict[str, float], float]):
        weights, self.intercept = model
        self.weights = list(weights.values())
        self.number = {f: i for i, f in enumerate(weights)}
        self.kept: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        found = self.kept[word] = tuple(self.number[f] for f in word_features(word) if f in self.number)
        return found

    def score(self, text: str) -> float:
        kept, found = self.kept, set()
        for word in set(text.lower().split()):
            has = kept.get(word)
            if has is None:
                has = self.of_word(word)
            if has:
                found.update(has)
        z = self.intercept + sum(self.weights[i] for i in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], float], text: str = "text") -> DataFrame:
    """The rows with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features and the terms
    rows = docs.select(text_of(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]).alias("row"))
    schema = T.StructType().add("score", T.DoubleType()).add("row", rows.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(sent, Scorer)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), batch.column("row")], schema.names)

    return rows.mapInArrow(run, schema).select("row.*", "score")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below ``TOXIC``, with all their columns."""
    scored = score_toxicity(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_of().alias("text")), fit_toxicity(docs, labels))
    return scored.where(F.col("score") < TOXIC).select("doc.*")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )
