"""Exact top-k inner products over vectors sorted by length.

Components become whole numbers (1,024 times, rounded down). Vectors are sorted by descending length and packed into
blocks in that order. All are rotated by the singular vectors of the table, so that few leading components hold most of
an inner product. For a query with bound ``b`` (the k-th best score so far):

* vectors shorter than b over the query's length end the block, by the Cauchy-Schwarz inequality;
* the partial sum over leading components plus the product of the lengths of both remainders bounds the score; vectors
  below b go, first after a quarter of the components, then after half;
* what is left is scored exactly, in whole numbers.

The longest vectors are searched first and give every query its bound for all other blocks. Bounds are floating-point
numbers and get a slack for rounding; scores never are. The rotation only orders the work, it is fitted on the sum of
products over all vectors (a matrix of dimension times dimension).

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
id; repeated rows count once; of rows with a query's id none is its own candidate; vectors of different dimensions don't
meet; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.llm.registry import query
from cohortspark.llm.vectors import pack_blocks, query_groups, ranked, search, usable
from cohortspark.sources.checkpoints import durable

#: Results of a query, factor of the components, vectors of a block, every how many-th id is a query.
K, FACTOR, BLOCK, EVERY = 10, 1024, 4096, 100

#: Vectors between which a block's bound is renewed.
STRIDE = 1024

#: Rows that partial sums of products are gathered in before the driver adds them up.
SUMS = 16


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the singular vectors, largest first, of all vectors."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer()).reshape(-1, dim)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        if sums:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(sums, pa.int32()), "sums": [s.tobytes() for s in sums.values()]})

    def add(found: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer()) for s in found["sums"])
        return pa.table({"dim": found["dim"].slice(0, 1), "sums": [total.tobytes()]})

    kinds = "dim int, sums binary"
    partial = blocks.select("dim", "data").mapInArrow(products, kinds).withColumn("place", F.spark_partition_id() % SUMS)
    rows = partial.groupBy("dim", "place").applyInArrow(lambda t: add(t.select(["dim", "sums"])), kinds).collect()
    totals: dict[int, np.ndarray] = {}
    for r in rows:
        totals[r["dim"]] = totals.get(r["dim"], 0) + np.frombuffer(r["sums"]).reshape(r["dim"], -1)
    return {dim: np.linalg.svd(total / max(1.0, np.abs(total).max()))[0] for dim, total in totals.items()}


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; exact in doubles when they are small, else with Python's integers."""
    if len(x) == 0:
        return np.zeros(0, np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2**53:
        return (x @ q).astype(np.int64)
    least, most = -(2**63), 2**63 - 1
    whole = [int(v) for v in q]
    return np.array([max(least, min(most, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], np.int64)


def top_products(k: int, rotation: dict[int, np.ndarray]):
    """The kernel of one block and one group of queries."""

    def best_of(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def kernel(query: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray) -> list[tuple]:
        turn = rotation[q.shape[1]]
        length = np.sqrt((x**2).sum(1))
        order = np.argsort(-length, kind="stable")
        x, ids, length = x[order], ids[order], length[order]
        xr, qr, q_length = x @ turn, q @ turn, np.sqrt((q**2).sum(1))
        leads = sorted({max(1, q.shape[1] // 4), max(1, q.shape[1] // 2)})
        x_rest = [np.sqrt((xr[:, lead:] ** 2).sum(1)) for lead in leads]
        q_rest = [np.sqrt((qr[:, lead:] ** 2).sum(1)) for lead in leads]
        found = []
        for i, own in enumerate(query):
            held_ids, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
            least = bound[i]
            for start in range(0, len(ids), STRIDE):
                slack = 1e-9 * q_length[i] * length[start] + 1e-6
                if q_length[i] * length[start] < least - slack:
                    break
                alive = np.arange(start, min(start + STRIDE, len(ids)))
                for lead, xs, qs in zip(leads, x_rest, q_rest):
                    partial = xr[alive, :lead] @ qr[i, :lead]
                    alive = alive[partial + xs[alive] * qs[i] >= least - slack]
                alive = alive[ids[alive] != own]
                scores = exact(x[alive], q[i])
                good = scores >= least
                held_ids, held = best_of(np.concatenate([held_ids, ids[alive][good]]), np.concatenate([held, scores[good]]))
                if len(held) == k:
                    least = max(least, float(held[-1]))
            found.append((held_ids, held))
        return found

    return kernel


def top_inner_products(vectors: DataFrame, k: int = K, factor: int = FACTOR, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` its k highest scores."""
    whole = F.transform("x", lambda v: F.floor(v * factor).cast("double"))
    rows = durable(usable(vectors, nonzero=False).select("vec_id", whole.alias("x")).distinct())
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    parts = -(-rows.count() // block) or 1
    order = [squares.desc(), F.col("vec_id").asc()]
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = durable(pack_blocks(sorted_rows, block))
    queries, groups = query_groups(rows, F.col("vec_id") % every == 0)
    kernel = top_products(k, rotations(blocks))
    lowest = float("-inf")
    found = search(blocks, queries, groups, kernel, lambda s: float(s[-1]) if len(s) == k else lowest, lowest, "bigint")
    return ranked(found, k, descending=True)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.x::DOUBLE[], v.x::DOUBLE[]) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_exact_top_k", SQL)
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_inner_products(table(spark, folder, "embeddings"))
