"""Small documents with the awkward cases, and plain versions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, first=0):
    """Documents numbered from ``first``; a text may be None."""
    rows = [
        (first + i, t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same rows with further columns that have the names of what operators use inside."""
    from pyspark.sql import functions as F

    names = ["row", "id", "key", "unit", "size", "score", "ids", "decoded", "hash", "n_tokens", "positions", "copies", "part", "same", "n"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def awkward_texts():
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(6000))
    return [None, "", " \n\t ", "one", "Two words", "日本語 🙂 text", "a\x0bb\x0cc\r\nd", "same text here", "same text here", long, "x" * 5000]
