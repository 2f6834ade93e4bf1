"""Reranking, diversification, passages and the scoring of web results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded

# Weights of the rerank features by quality mode.
WEIGHTS = {
    "standard": {"parent_relevance": 0.2, "section_match": 0.2, "confidence": 0.3, "adjacency_bonus": 0.2, "doc_type_match": 0.1, "question_density": 0.0},
    "precision": {"parent_relevance": 0.2, "section_match": 0.3, "confidence": 0.3, "adjacency_bonus": 0.1, "doc_type_match": 0.1, "question_density": 0.0},
    "recall": {"parent_relevance": 0.1, "section_match": 0.1, "confidence": 0.4, "adjacency_bonus": 0.2, "doc_type_match": 0.2, "question_density": 0.0},
    "extract": {"parent_relevance": 0.1, "section_match": 0.1, "confidence": 0.3, "adjacency_bonus": 0.1, "doc_type_match": 0.1, "question_density": 0.3},
}


def weighted(features: DataFrame, mode: str = "standard") -> DataFrame:
    w = WEIGHTS.get(mode.strip().lower(), WEIGHTS["standard"])
    return features.withColumn("weighted_score", sum((F.col(k) * v for k, v in w.items()), F.lit(0.0)))


def rerank_features(matches: DataFrame, mode: str = "standard") -> DataFrame:
    """matches: query_id, id, doc, section, ord, score, parent_relevance, doc_type, want_type, density.

    Features are relative to the anchor, the match of the highest score (the first of equals).
    """
    anchor = matches.groupBy("query_id").agg(F.max_by(F.struct("id", "doc", "section", "ord"), F.struct("score", -F.col("ord"), -F.col("id"))).alias("a"))
    order = Window.partitionBy("query_id", "doc", "section").orderBy("ord", "id")
    placed = matches.withColumn("place", F.row_number().over(order))
    where = placed.select("query_id", "id", F.col("place").alias("anchor_place")).join(anchor.select("query_id", F.col("a.id").alias("id"), "a"), ["query_id", "id"]).drop("id")
    m = placed.join(where, "query_id")
    same = (F.col("doc") == F.col("a.doc")) & F.col("section").eqNullSafe(F.col("a.section"))
    return weighted(m.select(
        "query_id", "id", "parent_relevance",
        F.col("section").eqNullSafe(F.col("a.section")).cast("double").alias("section_match"),
        F.col("score").alias("confidence"),
        (same & (F.abs(F.col("place") - F.col("anchor_place")) == 1)).cast("double").alias("adjacency_bonus"),
        F.coalesce(F.col("doc_type") == F.col("want_type"), F.lit(False)).cast("double").alias("doc_type_match"),
        F.col("density").alias("question_density"),
    ), mode)


def reranked(matches: DataFrame, top_k: int, pool: int = 20, extract: bool = False) -> DataFrame:
    """matches: query_id, id, score, density, is_primary, chunk_index, is_neighbour.

    A pool of candidates (and neighbours outside it) is ordered: primary document's chunks by
    index first, then by score, to which an extraction adds 0.15 of the question density.
    At least top_k rows stay, or as many as there are primary ones.
    """
    w = Window.partitionBy("query_id")
    m = matches.withColumn("_p", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where((F.col("_p") <= pool) | F.col("is_neighbour"))
    boosted = F.round(F.col("score") + (0.15 * F.col("density") if extract else 0), 6)
    m = m.withColumn("final", boosted).withColumn("_n", F.sum(F.col("is_primary").cast("int")).over(w))
    order = [F.desc("is_primary"), F.when(F.col("is_primary"), F.col("chunk_index")), F.desc("final"), F.asc("id")]
    return m.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= F.greatest(F.lit(top_k), F.col("_n"))).drop("_p", "_n")


def applied_order(base: DataFrame, ranking: DataFrame) -> DataFrame:
    """base (query_id, id, base_rank) by a ranking (query_id, id, position); unranked rows follow in base order."""
    first = ranking.groupBy("query_id", "id").agg(F.min("position").alias("position"))
    joined = base.join(first, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), "base_rank", "id")
    return joined.withColumn("rank", F.row_number().over(w))


def _mmr(pdf: pd.DataFrame, k: int, weight: float, penalty) -> pd.DataFrame:
    rows, chosen = pdf.sort_values(["score", "id"], ascending=[False, True]).to_dict("records"), []
    while rows and len(chosen) < k:
        best = max(range(len(rows)), key=lambda i: (weight * rows[i]["score"] - (1 - weight) * max((penalty(rows[i], c) for c in chosen), default=0.0), -i))
        chosen.append(rows.pop(best))
    return pd.DataFrame([{"query_id": c["query_id"], "id": c["id"], "rank": i + 1} for i, c in enumerate(chosen)])


def overlap(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def pooled(candidates: DataFrame, pool: int) -> DataFrame:
    """The best `pool` rows of a query: what a greedy choice works on in one task."""
    return candidates.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("_p") <= pool).drop("_p")


def mmr(candidates: DataFrame, k: int, strength: float = 0.3, pool: int = 200) -> DataFrame:
    """query_id, id, rank: greedy marginal relevance of the best `pool` rows of a query.

    candidates: query_id, id, doc, score, tokens (a set). Rows of one document don't repel.
    """
    penalty = lambda a, b: 0.0 if a["doc"] == b["doc"] else overlap(a["tokens"], b["tokens"])
    return pooled(candidates, pool).groupBy("query_id").applyInPandas(lambda p: _mmr(p, k, 1 - strength, penalty), "query_id long, id long, rank int")


def mmr_light(candidates: DataFrame, k: int, pool: int = 200) -> DataFrame:
    """The web form: 0.7 of the score, less 0.3 of the largest overlap, 0.85 at least on one host."""
    penalty = lambda a, b: max(overlap(a["tokens"], b["tokens"]), 0.85 if a["host"] == b["host"] else 0.0)
    return pooled(candidates, pool).groupBy("query_id").applyInPandas(lambda p: _mmr(p, k, 0.7, penalty), "query_id long, id long, rank int")


def within_budget(snippets: DataFrame, budget: int = 1800) -> DataFrame:
    """Rows in order (query_id, rank, tokens) up to the first that overflows the budget."""
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return snippets.withColumn("used_tokens", run).where(F.col("used_tokens") <= budget)


def confidence(matches: DataFrame) -> DataFrame:
    """query_id, top, delta: the best positive score, and what it leads the third (or second) by."""
    s = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.col("score"))))), 1, 3)
    got = matches.groupBy("query_id").agg(s.alias("s"))
    top = F.coalesce(F.get("s", F.lit(0)), F.lit(0.0))
    return got.select("query_id", F.round(top, 6).alias("top"), F.round(F.when(F.size("s") < 2, top).otherwise(top - F.element_at("s", -1)), 6).alias("delta"))


def retry_params(conf: DataFrame, min_sim: float, top_k: int, most: int, n: int = 1) -> DataFrame:
    """Which queries are asked again, and with what: a lower cut-off and more candidates."""
    again = (F.col("top") < 0.65) | (F.col("delta") < 0.05)
    return conf.select("query_id", again.alias("retry"), F.lit(min_sim * 0.5**n).alias("min_sim"), F.lit(min(top_k + 2 * n, 2 * top_k)).alias("top_k"), F.lit(min(most + 10 * n, 2 * most)).alias("max_candidates"))


def web_heuristics(title: Column, snippet: Column, url: Column, position: Column, query: Column) -> Column:
    """0 to 100: title (30, or 15 for a longer word), words / 20, mentions, bad URLs, first places."""
    title, snippet, url, query = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, snippet, url, query))
    longer = F.exists(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 3), lambda w: F.contains(title, w))
    words = F.size(F.filter(F.split(F.trim(snippet), r"\s+"), lambda w: w != ""))
    mentions = F.when(query == "", 0).otherwise((F.length(snippet) - F.length(F.replace(snippet, query, F.lit("")))) / F.length(query))
    bad = url.rlike("login|signup|register|cookie-policy|privacy-policy")
    score = F.when(F.contains(title, query), 30.0).when(longer, 15.0).otherwise(0.0) + F.least(words / 20.0, F.lit(25.0)) + F.least(mentions * 10.0, F.lit(20.0)) - F.when(bad, 20.0).otherwise(0.0) + F.when(F.coalesce(position, F.lit(0)) < 3, 5.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(score, F.lit(100.0)))


def blended(similarity: Column, heuristic: Column, weight: float = 0.6) -> Column:
    return weight * 100 * similarity + (1 - weight) * heuristic


def fallback_score(position: Column, age_days: Column, trust: Column) -> Column:
    """60 less 2 a place, fresher and trusted results more."""
    return 60 - 2 * position + F.greatest(F.lit(0.0), 30 - age_days / 12) + F.when(trust == "high", 10).otherwise(0)


def final_fusion(position: Column, closes_gap: Column, new_domain: Column, policy: Column, priority: Column, k: int = 90) -> Column:
    """Reciprocal rank with bonuses for coverage gaps, domains and policy priorities."""
    gap = F.when(closes_gap, 1 / (k + 1)).otherwise(0.0)
    domain = F.when(new_domain, 1 / (k + 1)).otherwise(1 / (k + 2))
    rule = F.when(policy == "boost", priority / 100 / (k + 0.5)).when(policy == "reject", -priority / 100 / (k + 0.5)).otherwise(0.0)
    return 1 / (k + position) + gap + domain + rule


def diverse(scored: DataFrame, k: int, least: int) -> DataFrame:
    """The k best of a query (query_id, id, bucket, score), of at least `least` buckets where there are so many."""
    w = Window.partitionBy("query_id")
    firsts = scored.withColumn("_b", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc("score"), "id")))
    firsts = firsts.withColumn("_lead", F.when(F.col("_b") == 1, F.row_number().over(w.orderBy(F.when(F.col("_b") == 1, 0).otherwise(1), F.desc("score"), "id"))))
    return firsts.withColumn("rank", F.row_number().over(w.orderBy(F.when(F.col("_lead") <= least, 0).otherwise(1), F.desc("score"), "id"))).where(F.col("rank") <= k).drop("_b", "_lead")


def candidate_flags(candidates: DataFrame, reject: Column, stale: Column) -> DataFrame:
    """candidates (query_id, id, url_key, snippet): the first reason against each, and whether it is kept.

    If nothing passes, the rows that no policy blocks are kept.
    """
    dup = F.row_number().over(Window.partitionBy("query_id", "url_key").orderBy("id")) > 1
    reason = F.when(reject, "policy_block").when(F.col("_dup"), "duplicate").when(F.trim("snippet") == "", "empty_snippet").when(stale, "stale")
    out = candidates.withColumn("_dup", dup).withColumn("reason", reason).drop("_dup")
    passed = F.max(F.col("reason").isNull()).over(Window.partitionBy("query_id"))
    return out.withColumn("kept", F.when(passed, F.col("reason").isNull()).otherwise(F.coalesce(F.col("reason") != "policy_block", F.lit(True))))


def component_top(components: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """component, id, score, rank: a hit's score plus 0.05 for each of a component's words in its text.

    components (component, words) is the stated query set; each task keeps k hits a component.
    """
    both = hits.crossJoin(bounded(components))
    score = F.round(F.col("score") + 0.05 * F.size(F.filter("words", lambda w: F.contains(F.lower(F.col("text")), w))), 6)
    w = Window.partitionBy("component").orderBy(F.desc("score"), "id")
    return both.select("component", "id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


