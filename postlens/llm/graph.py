"""Connected components as Spark jobs: alternating stars, one table in the shared folder a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the least v of each u, counted by partial minima. As a table of its own it may be joined with the
    pairs of a hub in several tasks: Spark splits a skewed side only if no aggregation shares its stage."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these."""
    joined = edges.join(_least(edges), "u")
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (long, any order). Returns node, root: the least node reachable; nodes without edges are absent."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_small_star(_large_star(now)), "edges")
        new = _digest(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
