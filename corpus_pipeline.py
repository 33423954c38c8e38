"""From raw documents to encoded training data: each stage takes the documents that the one before has kept.

Toxic documents go, then lines that a document with a smaller id holds too, then all but one of each group of similar
documents; the rest is mixed to the sources' target weights (documents repeat or go), and encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.byte_codec import VOCABULARY, encode_decode
from cohortspark.llm.common import table
from cohortspark.llm.jaccard_join import keep_one_of_each
from cohortspark.llm.line_dedup import drop_shared_lines
from cohortspark.llm.mixing import mix_documents
from cohortspark.llm.toxicity import drop_toxic
from cohortspark.sources.checkpoints import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; shared lines stay in one of them only."""
    return drop_shared_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the hashes of the ids and of the bytes that they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    coded = encode_decode(docs.select("doc_id", "source", "lang", "text"), path, pattern)
    return coded.select(
        "doc_id",
        "source",
        "lang",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: A trained classifier, random rounding and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
