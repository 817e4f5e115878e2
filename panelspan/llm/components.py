"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is one aggregation (with partial sums) and one join, so a vertex with very many
neighbours is never gathered in one place, and no step needs more rows than there are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _toward_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v) in both directions, with the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written first: next to the aggregation a crowded vertex's part of the join could not be split.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    return _toward_least(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v: joins the smaller neighbours of u, and u itself, to the least of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    linked = edges.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of one comparable type -> (node, component): the least node that each one reaches.

    Nodes without an edge aren't returned; loops and nulls are ignored. Raises if it doesn't settle in ``rounds``.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges)
    before = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("component")).distinct().toDF("node", "component"))
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
