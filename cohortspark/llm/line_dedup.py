"""Lines that several documents share stay in one document only.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys are reduced to 128-bit hashes; the
distinct documents of each hash are counted, lines whose hash is in too many documents go everywhere but in the
document with the smallest id, and the lines that stay are put together again by position.

Only hashes, ids and positions are shuffled for counting. The text is shuffled once, when each document meets the
positions that it loses. A line that a third of all documents share is counted in the map tasks first, and its join
partition is split at run time because the next step groups by another key.

Defined results: a null or empty text is one empty line; short keys always stay; rows without id count as one further
document behind all others; rows with the same id count as one document and lose the same lines; an empty table gives
an empty result; further columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import BLANKS, ascii_lower, table, text_of, with_columns
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

#: Stands for a missing id when documents are counted and compared.
NO_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, digest of the text, positions that go), for the rows of (id, digest, text) that lose lines."""
    lines = docs.select("id", "digest", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("id", "digest", "pos", line_key(F.col("line")).alias("key"))
    keys = durable(
        keys.where(F.char_length("key") >= min_chars).select("id", "digest", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    counted = keys.select("hash", "id").distinct().groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("keeper"))
    # stored, so that both sides of the join come straight from a shuffle and a hot hash can be split
    shared = durable(counted.where(F.col("n") >= min_docs).select("hash", "keeper"))
    gone = keys.join(shared, "hash").where(F.col("id") != F.col("keeper"))
    return gone.groupBy("id", "digest").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def without(lines: Column, positions: Column) -> Column:
    """The array without the elements at sorted positions (from 0), in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), positions)
    after = F.concat(positions, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def deduplicate_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of ``docs`` as a struct, and its text after shared lines are gone."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text_of(text)).alias("digest"),
        text_of(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()]).alias("row"),
    )
    gone = dropped_positions(rows.select("id", "digest", "text"), min_chars, min_docs)
    met = rows.join(gone.hint("shuffle_hash"), ["id", "digest"], "left")
    lines = F.split("text", "\n")
    return met.select(
        "row",
        F.when(F.col("positions").isNull(), F.col("text"))
        .otherwise(F.array_join(without(lines, F.col("positions")), "\n"))
        .alias("text"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without lines that a document with a smaller id holds too."""
    kept = deduplicate_lines(docs).select("row.*", "text")
    if "n_chars" in docs.columns:
        kept = with_columns(kept, n_chars=F.char_length("text").cast("long"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
  (count(*) FILTER (WHERE s.keeper <> k.doc_id))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.keeper IS NULL OR s.keeper = k.doc_id), ''))
    AS kept_sha256
FROM k LEFT JOIN s ON k.key = s.key GROUP BY k.doc_id
"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = deduplicate_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
