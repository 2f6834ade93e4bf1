"""The evidence graph: edges between chunks, hops and induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(chunks: DataFrame) -> DataFrame:
    """src, dst, kind of chunks (id, document, section, ord, parents array, refs array): adjacency both ways, parent, child, reference, backref."""
    w = Window.partitionBy("document", "section").orderBy(F.col("ord").asc_nulls_last(), "id")
    next_ = chunks.select("id", F.lead("id").over(w).alias("n")).where("n IS NOT NULL")
    near = next_.select(F.col("id").alias("src"), F.col("n").alias("dst"), F.lit("adjacent").alias("kind"))
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    known = chunks.select(F.col("id").alias("dst"))
    up = chunks.select(F.col("id").alias("src"), F.explode("parents").alias("dst")).join(known, "dst").select("src", "dst", F.lit("parent").alias("kind"))
    to = chunks.select(F.col("id").alias("src"), F.explode("refs").alias("dst")).join(known, "dst").select("src", "dst", F.lit("reference").alias("kind"))
    turn = lambda e, kind: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(kind).alias("kind"))
    return near.union(back).union(up).union(turn(up, "child")).union(to).union(turn(to, "backref")).distinct()


def hops(edges_: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """seed, id, hop: nodes within k adjacency steps of each seed, at their least distance."""
    e = edges_.where("kind = 'adjacent'").select("src", "dst")
    out = seeds.select(F.col("id").alias("seed"), F.col("id"), F.lit(0).alias("hop"))
    front = out
    for h in range(1, k + 1):
        front = front.join(e, front["id"] == e["src"]).select("seed", F.col("dst").alias("id"), F.lit(h).alias("hop")).distinct()
        out = out.union(front)
    return out.groupBy("seed", "id").agg(F.min("hop").alias("hop"))


def parents(edges_: DataFrame) -> DataFrame:
    """id, parent: the least of a chunk's parents."""
    return edges_.where("kind = 'parent'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))


def induced(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between chosen nodes."""
    n = nodes.select("id").distinct()
    return edges_.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
