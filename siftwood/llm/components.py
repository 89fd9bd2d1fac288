"""Connected components of a distributed edge table by alternating large and small stars.

Each star joins the edges with a checkpointed table of one row per node, so that
both sides of the join are plain exchanges and adaptive execution can split the
partition of a hub. Nulls among u and v are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = fixed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, point to the least of them. edges: u > v."""
    least = fixed(edges.groupBy("u").agg(F.min("v").alias("m")))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of all nodes with an edge. edges: u, v of one orderable type."""
    now = fixed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    shape = None
    for _ in range(MOST_ROUNDS if now.take(1) else 1):
        now = fixed(_small_star(_large_star(now)))
        # Stars alone: as many edges as nodes that have one, and no root that has a root.
        new = now.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == shape or not new[0]:
            break
        shape = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
