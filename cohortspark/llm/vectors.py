"""Vectors in packed blocks, and a stated set of queries met with all blocks.

Blocks of vectors and groups of queries are single rows of packed numbers. Every block meets every group of queries
through an equality join on the group's number, so tasks hold one block and one group at a time, whatever the size of
the table. A first, small join with one block gives each query a bound that the search of all others starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.checkpoints import durable

#: Queries of a group.
GROUP = 512

PACKED = "dim int, seed boolean, ids binary, data binary"
FOUND = "grp long, dim int, bound binary, found array<struct<query_id:bigint,copy:bigint,vec_id:bigint,score:{kind}>>"


def usable(vectors: DataFrame, nonzero: bool, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x: array of double) of the rows with an id and a vector of finite numbers; repeated rows count once."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col(vec_id).isNotNull() & (F.size(x) > 0) & finite
    rows = vectors.where(F.coalesce(good & F.exists(x, lambda v: v != 0) if nonzero else good, F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).distinct()


def pack_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (vec_id, x) of each partition, in their order, as blocks of one dimension. The very first block is the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        first = TaskContext.get().partitionId() == 0
        done: set[int] = set()

        def emit(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dim]])
            data = np.concatenate([d for _, d in held[dim]])
            seed = first and dim not in done
            done.add(dim)
            held[dim] = []
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "seed": [seed], "ids": [ids.tobytes()], "data": [data.tobytes()]}
            )

        for batch in batches:
            x = batch.column("x")
            ids, sizes = batch.column("vec_id").to_numpy(), np.diff(x.offsets.to_numpy())
            flat, starts = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                data = flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                for i in range(0, len(at), block):
                    held.setdefault(dim, []).append((ids[at[i : i + block]], data[i : i + block]))
                    if sum(len(a) for a, _ in held[dim]) >= block:
                        yield emit(dim)
        for dim, parts in list(held.items()):
            if parts:
                yield emit(dim)

    return rows.select("vec_id", "x").mapInArrow(run, PACKED)


def query_groups(rows: DataFrame, chosen: Column, group: int = GROUP) -> tuple[DataFrame, int]:
    """(grp, dim, ids, copies, data) of the chosen rows, and the number of groups. Both grow with the queries only."""
    queries = rows.where(chosen)
    groups = -(-queries.count() // group) or 1
    number = F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups))

    def run(found: pa.Table) -> pa.Table:
        dims = np.array([len(x) for x in found["x"]])
        rows = []
        for dim in np.unique(dims).tolist():
            part = found.filter(pa.array(dims == dim))
            data = part["x"].combine_chunks().flatten().to_numpy().astype(np.float64)
            ids, copies = part["vec_id"].to_numpy(), part["copy"].to_numpy()
            rows.append({"grp": found["grp"][0].as_py(), "dim": dim, "query": ids.tobytes(), "copies": copies.tobytes(), "q": data.tobytes()})
        kinds = [("grp", pa.int64()), ("dim", pa.int32()), ("query", pa.binary()), ("copies", pa.binary()), ("q", pa.binary())]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    numbered = queries.select(number.alias("grp"), "vec_id", F.xxhash64("x").alias("copy"), "x")
    packed = numbered.groupBy("grp").applyInArrow(run, "grp long, dim int, query binary, copies binary, q binary")
    return durable(packed), groups


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def search(
    blocks: DataFrame, queries: DataFrame, groups: int, kernel: Kernel, best: Callable[[np.ndarray], float], unbounded: float, kind: str
) -> DataFrame:
    """(query_id, copy, vec_id, score) that the kernel finds.

    ``kernel(query ids, queries, ids, vectors, bounds)`` gives (ids, scores) for each query; ``best`` makes a bound of
    a query's scores in the seed block.
    """
    schema = FOUND.format(kind=kind)
    score = pa.int64() if kind == "bigint" else pa.float64()
    item = pa.struct([("query_id", pa.int64()), ("copy", pa.int64()), ("vec_id", pa.int64()), ("score", score)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query, copies = np.frombuffer(row["query"], np.int64), np.frombuffer(row["copies"], np.int64)
                q = np.frombuffer(row["q"]).reshape(len(query), -1)
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["data"]).reshape(len(ids), -1)
                bound = np.frombuffer(row["bound"]) if row["bound"] else np.full(len(query), unbounded)
                found = kernel(query, q, ids, x, bound)
                bounds = np.array([best(s) for _, s in found], float)
                items = pa.StructArray.from_arrays(
                    [
                        pa.array(np.repeat(query, [len(i) for i, _ in found])),
                        pa.array(np.repeat(copies, [len(i) for i, _ in found])),
                        pa.array(np.concatenate([i for i, _ in found]), pa.int64()),
                        pa.array(np.concatenate([s for _, s in found]), score),
                    ],
                    fields=list(item),
                )
                lists = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]], pa.int64()), pa.array([row["dim"]], pa.int32()), pa.array([bounds.tobytes()], pa.binary()), lists],
                    ["grp", "dim", "bound", "found"],
                )

    def met(part: DataFrame, asked: DataFrame) -> DataFrame:
        numbered = part.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        pairs = numbered.join(asked, ["grp", "dim"]).select("grp", "dim", "query", "copies", "q", "bound", "ids", "data")
        return pairs.mapInArrow(run, schema)

    seeded = durable(met(blocks.where("seed"), queries.withColumn("bound", F.lit(None).cast("binary"))))
    bounded = durable(queries.join(seeded.select("grp", "dim", "bound"), ["grp", "dim"], "left"))
    rest = met(blocks.where(~F.col("seed")), bounded)
    every = seeded.select("found").unionByName(rest.select("found"))
    return every.select(F.explode("found").alias("f")).select("f.*")


def ranked(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of each query, ties to the smaller id: (query_id, rank, vec_id, score)."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

