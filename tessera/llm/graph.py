"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v, no loops.

    Large star: every larger neighbour of a node is tied to the node's least neighbour.
    Small star: a node and its smaller neighbours are tied to the least of them.
    Minima are pre-aggregated before the shuffle; a node with very many neighbours meets its
    minimum in a plain join, which adaptive execution splits.
    """
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component is the least node.

    Alternating large and small stars until the edges are stars and stay the same. Each step
    is checkpointed, so lineage doesn't grow. Nodes that are in no link aren't returned;
    loops and repeated links do nothing; nulls are left out.
    """
    edges = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        edges = cut(_star(cut(_star(edges, True)), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
