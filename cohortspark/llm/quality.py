"""A quality classifier by attention over a document's passages.

Passages are pieces of 1,024 bytes. Each is described by the shares of kinds of characters, its words' length and how
often words repeat, and encoded by a layer of its own. Gated attention gives each passage a weight (a softmax over the
document of a linear function of a hyperbolic tangent times a logistic gate), the document is the weighted mean of its
encoded passages, and a logistic function of that is the score. All weights are learned together from labels of
documents; no passage has a label.

The fit is made on a bounded sample of labelled documents (``PER_CLASS`` for each label) with all their passages. If they
have more than ``MOST_PASSAGES``, documents of each label are taken by a hash of the text, whatever their length, and
weigh as much as all of the label; at least one of each label is taken, however long. Every document is scored whole,
with array operations over batches of texts.

Defined results: a null or empty text is one passage without characters; a document without id is scored and not held
out; without labels of both kinds every score is 1 or 0 as the only label says (0 without labels); repeated rows get the
same score; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import slices, table, text_of
from cohortspark.llm.labelled import fold_of, labelled_sample
from cohortspark.llm.registry import query

#: Labelled documents of each kind to fit on, and passages of the sample that the fit takes at most.
PER_CLASS, MOST_PASSAGES = 4000, 200_000

#: Bytes of a passage, units of the encoding and of the attention, rounds of the fit.
PASSAGE, ENCODED, ATTENTION, ROUNDS = 1024, 16, 8, 250

#: From this score on the label 1 is predicted. The held-out fold of labels, of how many.
GOOD, FOLDS, HELD_OUT = 0.7, 4, 2

#: Kinds of characters, by byte; bytes above 127 are the last kind.
KINDS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f", b"\r\n", b".,;:", b"!?",
    b"|<>{}[]\\/", b"#$%&*@^~+=_`", b"\"'()-",
)
_KIND = np.full(256, len(KINDS) + 1, np.uint8)
for _i, _chars in enumerate(KINDS):
    _KIND[list(_chars)] = _i
_KIND[128:] = len(KINDS)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(6).integers(0, 1 << 62, 256, dtype=np.uint64)
MEASURES = len(KINDS) + 2 + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages of all texts, and the first passage of each text (one more than texts)."""
    sizes = np.array([len(t) for t in texts])
    number = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(number)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], number)
    ends = np.cumsum(sizes)
    starts = np.repeat(ends - sizes, number) + place * PASSAGE
    stops = np.minimum(starts + PASSAGE, np.repeat(ends, number))
    length = (stops - starts).astype(float)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros((first[-1], MEASURES))
    kinds = len(KINDS) + 2
    if len(raw):
        passage = np.repeat(np.arange(first[-1]), stops - starts)
        flat = np.bincount(passage * kinds + _KIND[raw], minlength=first[-1] * kinds)
        out[:, :kinds] = flat.reshape(-1, kinds) / np.maximum(length, 1)[:, None]
        word = ~_BLANK[raw]
        begins = word.copy()
        begins[1:] &= _BLANK[raw[:-1]] | (passage[1:] != passage[:-1])
        at = np.flatnonzero(begins)
        of = passage[at]
        words = np.bincount(of, minlength=first[-1]).astype(float)
        if len(at):
            # blanks count nothing, so a word's sum names it well enough to find repetitions
            name = np.add.reduceat(np.where(word, _BYTE[raw], np.uint64(0)), at)
            for k in (1, 2):
                same = (name[k:] == name[:-k]) & (of[k:] == of[:-k])
                out[:, kinds + k - 1] = np.bincount(of[k:][same], minlength=first[-1]) / np.maximum(words, 1)
            order = np.lexsort((name, of))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])
            out[:, kinds + 2] = np.bincount(of[order][fresh], minlength=first[-1]) / np.maximum(words, 1)
        out[:, kinds + 3] = word_length = np.bincount(passage[word], minlength=first[-1]) / np.maximum(words, 1)
        out[:, kinds + 3] = np.minimum(word_length, 50) / 10
        out[:, kinds + 4] = np.minimum(words, 300) / 300
    out[:, kinds + 5] = length / PASSAGE
    return out, first


class Attention:
    """Encoder, gated attention and classifier; ``weights`` are fitted by Adam."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)
        self.weights = {
            "encode": draw(MEASURES, ENCODED), "shift": np.zeros(ENCODED), "value": draw(ENCODED, ATTENTION),
            "gate": draw(ENCODED, ATTENTION), "attend": draw(ATTENTION, 1)[:, 0], "last": draw(ENCODED, 1)[:, 0],
            "bias": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, starts, number = self.weights, first[:-1], np.diff(first)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        encoded = np.tanh(x @ w["encode"] + w["shift"])
        value, gate = np.tanh(encoded @ w["value"]), 1 / (1 + np.exp(-encoded @ w["gate"]))
        raw = (value * gate) @ w["attend"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), number))
        share = raw / np.repeat(np.add.reduceat(raw, starts), number)
        document = np.add.reduceat(share[:, None] * encoded, starts)
        score = 1 / (1 + np.exp(-np.clip(document @ w["last"] + w["bias"], -30, 30)))
        return {"x": x, "encoded": encoded, "value": value, "gate": gate, "share": share, "document": document, "score": score}

    def slopes(self, first: np.ndarray, s: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss; ``error`` is that of each document, weighted."""
        w, number = self.weights, np.diff(first)
        back = np.repeat(error, number)[:, None] * w["last"]  # of each document's mean, at its passages
        along = (s["encoded"] * back).sum(1)
        raw = s["share"] * (along - np.repeat(np.add.reduceat(s["share"] * along, first[:-1]), number))
        at_value = raw[:, None] * w["attend"] * s["gate"] * (1 - s["value"] ** 2)
        at_gate = raw[:, None] * w["attend"] * s["value"] * s["gate"] * (1 - s["gate"])
        at_encoded = (s["share"][:, None] * back + at_value @ w["value"].T + at_gate @ w["gate"].T) * (1 - s["encoded"] ** 2)
        return {
            "encode": s["x"].T @ at_encoded, "shift": at_encoded.sum(0), "value": s["encoded"].T @ at_value,
            "gate": s["encoded"].T @ at_gate, "attend": (s["value"] * s["gate"]).T @ raw, "last": s["document"].T @ error,
            "bias": error.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Attention:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = weight / weight.sum()
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for i in range(1, rounds + 1):
            state = self.forward(x, first)
            for k, slope in self.slopes(first, state, weight * (state["score"] - y)).items():
                slope = slope + 1e-5 * self.weights[k]
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.99 * square[k] + 0.01 * slope**2
                step = mean[k] / (1 - 0.9**i) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-9)
                self.weights[k] = self.weights[k] - 0.03 * step
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts))["score"] if texts else np.zeros(0)


class Constant:
    """The score when there is only one label."""

    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def within(sample: DataFrame, most: int) -> DataFrame:
    """The sampled rows, of at most ``most`` passages unless a single document has more than its label may have.

    Only counts reach the driver, at most about twice ``PER_CLASS`` rows. Each label may have half of the passages, and
    what the other leaves; its documents are taken in the order of a hash until the next one is too long.
    """
    place = F.xxhash64("text")
    number = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE))
    rows = sample.select((F.col("label") > 0).alias("good"), place.alias("place"), number.alias("n"), "weight").collect()
    if sum(r["n"] for r in rows) <= most:
        return sample
    last, factor = F.lit(None).cast("long"), F.lit(1.0)
    total = {good: sum(r["n"] for r in rows if r["good"] == good) for good in (True, False)}
    for good in total:
        held = sorted((r for r in rows if r["good"] == good), key=lambda r: r["place"])
        if held:
            may = max(most // 2, most - total[not good])
            keep = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in held]), may, side="right")))
            weighs = sum(r["weight"] for r in held) / sum(r["weight"] for r in held[:keep])
            last = F.when((F.col("label") > 0) == good, held[keep - 1]["place"]).otherwise(last)
            factor = F.when((F.col("label") > 0) == good, weighs).otherwise(factor)
    return sample.where(place <= last).withColumn("weight", F.col("weight") * factor)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Attention | Constant:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, per_class)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column("text")):
                x, first = passages([t.encode() for t in part.to_pylist()])
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]
                columns = [batch.column(c).slice(done, len(part)) for c in ("label", "weight")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first), pa.int64()), pa.array(rows, pa.binary())], ["label", "weight", "n", "x"])
                done += len(part)

    measured = within(sample, MOST_PASSAGES).select("label", "weight", "text").mapInArrow(measure, "label int, weight double, n long, x binary")
    rows = measured.collect()  # at most about twice PER_CLASS documents and MOST_PASSAGES
    y = np.array([r["label"] > 0 for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Constant(float(len(y) > 0 and y[0]))
    rows.sort(key=lambda r: (r["n"], r["x"]))
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, MEASURES).astype(float)
    first = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
    y, weight = np.array([r["label"] > 0 for r in rows], float), np.array([r["weight"] for r in rows])
    return Attention().fit(x, first, y, weight)


def score_quality(docs: DataFrame, model: Attention | Constant, text: str = "text") -> DataFrame:
    """The rows with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    rows = docs.select(text_of(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"]).alias("row"))
    schema = T.StructType().add("score", T.DoubleType()).add("row", rows.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        for batch in batches:
            done = 0
            for part in slices(batch.column("text"), 1 << 20):
                scores = scorer.score([t.encode() for t in part.to_pylist()])
                row = batch.column("row").slice(done, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), row], schema.names)
                done += len(part)

    return rows.mapInArrow(run, schema).select("row.*", "score")


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
