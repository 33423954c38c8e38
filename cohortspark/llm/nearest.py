"""Approximate nearest neighbours by counting collisions of single projections.

Each block of vectors is projected on random directions, and each projection is a sorted array. A query looks at the
window around its own projection in each array; a vector in the window collides. Windows have the width that vectors at
distance R collide in with probability ``NEAR``; R starts small and is enlarged by a factor (virtual rehashing), so no
other hash functions are needed. Vectors with enough collisions are verified by their distance. A query ends when its
k-th nearest distance is at most R: then everything nearer has had its chance, each with a probability of at least
``CAUGHT``. The number of collisions that is enough follows from these two probabilities. Nothing caps the number of
vectors that are verified, and windows grow until they hold everything if need be.

One block is searched first; it bounds R for all other blocks. Windows are wider by the rounding error of a projection, so
exact copies collide in all of them, also when R is 0. Directions come from a seed, the first R from distances
between a bounded part of a block and of the queries. All rows are indexed and searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without id; repeated rows count once; of rows with a query's id none is its own candidate; vectors of different
dimensions don't meet; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.llm.registry import query
from cohortspark.llm.vectors import pack_blocks, query_groups, ranked, search, usable
from cohortspark.sources.checkpoints import durable

#: Results of a query, vectors of a block, every how many-th id is a query.
K, BLOCK, EVERY = 10, 16384, 100

#: Projections, probability to collide at distance R, probability to collide often enough, factor of R.
PROJECTIONS, NEAR, CAUGHT, ENLARGE = 48, 0.826, 0.97, 1.25

#: Half the window's width over R: a normal variable is within it with probability ``NEAR``.
HALF = 1.3594

#: Vectors and queries whose distances give the first R.
SAMPLE_VECTORS, SAMPLE_QUERIES = 1024, 32


def enough_collisions(projections: int = PROJECTIONS, near: float = NEAR, caught: float = CAUGHT) -> int:
    """The largest number of collisions that a vector at distance R reaches with probability ``caught``."""
    tail, least = 0.0, projections + 1
    while tail < caught:
        least -= 1
        tail += math.comb(projections, least) * near**least * (1 - near) ** (projections - least)
    return least


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def first_radius(q: np.ndarray, x: np.ndarray, k: int) -> float:
    """Most of the distance to the k-th nearest of a part of the block, for a middling query."""
    part = x[:SAMPLE_VECTORS]
    at = min(k, len(part) - 1)
    kth = [np.partition(distances(part, one), at)[at] for one in q[:SAMPLE_QUERIES]]
    return float(np.median(kth)) * 0.6 or 1e-6


def collision_counting(k: int, seed: int):
    """The kernel of one block and one group of queries."""
    least = enough_collisions()

    def kernel(query: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: np.ndarray) -> list[tuple]:
        directions = np.random.default_rng(seed).normal(size=(q.shape[1], PROJECTIONS))
        projected, own = x @ directions, q @ directions
        # each of two projections of equal vectors is at most half of this from the exact one
        slack = 2 * q.shape[1] * np.finfo(float).eps * (np.abs(q) @ np.abs(directions))
        order = np.argsort(projected, axis=0, kind="stable")
        arrays = [projected[order[:, j], j] for j in range(PROJECTIONS)]
        places = [np.ascontiguousarray(order[:, j]) for j in range(PROJECTIONS)]
        start = first_radius(q, x, k)
        found = []
        for i, name in enumerate(query):
            radius = min(start, bound[i])
            verified = np.zeros(len(ids), bool)
            verified[ids == name] = True
            held_ids, held = np.zeros(0, np.int64), np.zeros(0)
            while True:
                half = HALF * radius + slack[i]
                low = [a.searchsorted(p - h, "left") for a, p, h in zip(arrays, own[i], half)]
                high = [a.searchsorted(p + h, "right") for a, p, h in zip(arrays, own[i], half)]
                inside = np.concatenate([place[a:b] for place, a, b in zip(places, low, high)])
                often = np.bincount(inside, minlength=len(ids)) >= least
                new = np.flatnonzero(often & ~verified)
                verified[new] = True
                held_ids = np.concatenate([held_ids, ids[new]])
                held = np.concatenate([held, distances(x[new], q[i])])
                best = np.lexsort((held_ids, held))[:k]
                held_ids, held = held_ids[best], held[best]
                kth = min(bound[i], held[-1] if len(held) == k else np.inf)
                if kth <= radius or verified.all():
                    break
                radius = min(radius * ENLARGE, kth)
            found.append((held_ids, held))
        return found

    return kernel


def nearest_neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` the k nearest found."""
    rows = durable(usable(vectors, nonzero=True))
    parts = -(-rows.count() // block) or 1
    blocks = durable(pack_blocks(rows.repartition(parts, "vec_id"), block))
    queries, groups = query_groups(rows, F.col("vec_id") % every == 0)
    furthest = float("inf")
    found = search(
        blocks, queries, groups, collision_counting(k, seed), lambda s: float(s[-1]) if len(s) == k else furthest, furthest, "double"
    )
    return ranked(found, k, descending=False)


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))
