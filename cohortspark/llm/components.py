"""Connected components of a graph given as a table of links, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.checkpoints import durable


def _large_star(links: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node it knows."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    met = durable(both.where(F.col("v") > F.col("u"))).join(durable(least), "u")
    return met.select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node joins its smaller neighbours and itself to the smallest of them; every link has u > v."""
    least = durable(links.groupBy("u").agg(F.min("v").alias("least")))
    met = links.join(least, "u").where(F.col("v") != F.col("least"))
    moved = met.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v): for every node but a component's smallest, that smallest node. ``links`` has u and v.

    Large-star and small-star steps alternate until nothing changes, which takes few rounds (logarithmic in practice).
    Minima are combined in the map tasks, and the join of a node with very many links is split at run time. Every round
    is stored.
    """
    links = links.where(F.col("u") != F.col("v"))
    links = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = links.agg(*state).first()
    while before[0]:
        links = durable(_small_star(_large_star(links)))
        after = links.agg(*state).first()
        if after == before:
            break
        before = after
    return links
