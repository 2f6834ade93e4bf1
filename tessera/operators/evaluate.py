"""Retrieval quality and learning from feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, dedupe: bool = False) -> DataFrame:
    """query_id, recall, mrr, ndcg at k; ranked (query_id, id, rank), relevant (query_id, id), binary relevance.

    Repeated ids in a ranking count again unless dedupe is set.
    """
    top = ranked.where(F.col("rank") <= k)
    if dedupe:
        top = top.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    rel = relevant.select("query_id", "id").distinct()
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = top.join(rel, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(hits, "query_id", "left").select("query_id", F.round(z(F.col("hits") / F.col("n")), 6).alias("recall"), F.round(z(1 / F.col("first")), 6).alias("mrr"), F.round(z(F.col("dcg") / ideal), 6).alias("ndcg"))


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def drift(now: DataFrame, before: DataFrame, key: str, alert: float = -0.1) -> DataFrame:
    """Hit recall of a key, its change, and whether it fell by the alert's size."""
    j = now.join(before.withColumnRenamed("recall", "was"), key, "left").withColumn("delta", F.round(F.col("recall") - F.col("was"), 6))
    return j.select(key, "recall", "delta", F.coalesce(F.col("delta") <= alert, F.lit(False)).alias("alert"))


def learned_weights(events: DataFrame, by: list[str], base: dict[str, float], alpha: float = 0.5) -> DataFrame:
    """Weights of features from feedback (feedback_type, features map), a click counting double, blended with a profile."""
    factor = F.when(F.col("feedback_type") == "click", 2.0).otherwise(1.0)
    each = events.select(*by, factor.alias("f"), F.explode("features").alias("feature", "x")).where("x > 0")
    sums = each.groupBy(*by, "feature").agg(F.sum(F.col("f") * F.col("x")).alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy(*by))
    static = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("feature")), F.lit(0.0))
    mixed = sums.withColumn("w", alpha * share + (1 - alpha) * static)
    return mixed.select(*by, "feature", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(*by)), 6).alias("weight"))
