"""Bounded samples of labelled documents to fit classifiers on, and folds by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.checkpoints import durable


def fold_of(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text; null without id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(text, label, weight) of about ``per_class`` documents of each label outside the held-out fold, stored.

    The sample is drawn by a hash of the id from all labelled rows; each row weighs as many rows as it stands for, and
    equal texts count once. Ids with several labels take the largest. Only the sampled ids, whose number the bound
    limits, are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.col(label).cast("int")).alias("label")
    )
    known = durable(known.where(fold_of(F.col("id"), folds) != held_out))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a class
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, min(1.0, per_class / n)).otherwise(share)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    sampled = durable(known.withColumn("share", share).where(place < F.col("share")))
    met = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sampled), "id")
    met = met.select(F.coalesce("text", F.lit("")).alias("text"), "label", (1 / F.col("share")).alias("weight"))
    return durable(met.groupBy("text", "label").agg(F.sum("weight").alias("weight")))
