"""Connected components of an edge table, with tables only: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import drop, written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """~u as k, and the least v beside u or u itself. Joined by ~u, so that both sides of the join are dealt anew and a
    large partition of either can be split."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    joined = both.join(least, F.bitwise_not(both["u"]) == least["k"])
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    joined = down.join(least, F.bitwise_not(down["u"]) == least["k"])
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node but the least of its component, with that least node. edges: u, v (long), either way round.

    Ends when no step changes the edges; the number of steps grows with the logarithm of the longest chain.
    """
    edges = written(edges.where("u <> v").distinct(), "edges")
    mark = None
    while True:
        before = edges
        edges = written(_small_star(_large_star(before)), "edges")
        drop(before)
        total = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(total) == mark or not total["n"]:
            return edges
        mark = tuple(total)
