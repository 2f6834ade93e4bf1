"""Lexical and hybrid search over a batch of queries: legs, fusion, cut-offs, deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors

#: Similarity limits that are tried in turn when a trigram match finds nothing.
LADDER = [0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.0]


@dataclass(frozen=True)
class HybridParams:
    """Defaults of a hybrid search; values out of range are clamped."""

    top_k: int = 5
    alpha: float = 0.7
    min_sim: float = 0.15
    vec_limit: int = 50
    lex_limit: int = 50
    trgm_limit: float = 0.30
    max_candidates: int = 200
    rrf_k: int = 60

    def clamped(self) -> HybridParams:
        top_k = min(10, max(1, self.top_k))
        most = max(top_k, self.max_candidates)
        unit = lambda x: min(1.0, max(0.0, x))
        return HybridParams(top_k, unit(self.alpha), unit(self.min_sim), min(most, max(top_k, self.vec_limit)), min(most, max(top_k, self.lex_limit)), unit(self.trgm_limit), most, max(1, self.rrf_k))


def ranked(df: DataFrame, by: str, *order, name: str = "rank", most: int | None = None) -> DataFrame:
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return df.where(F.col(name) <= most) if most else df


def lexical(queries: DataFrame, corpus: DataFrame, limit: int, query_text: str = "q", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """query_id, id, lscore, rank: tenth of the occurrences of any query word in a text (an OR query).

    An inverted index by equi-join on words. Only words that some query has are kept, where the
    texts are read if these words are counted to be few enough to be broadcast; occurrences are
    counted before the shuffle.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(tx.WORD), F.lit(0))
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col(query_text)))).alias("w"))
    known = asked.select("w").distinct()
    known = F.broadcast(known) if known.count() <= broadcast_rows else known
    held = corpus.select("id", F.explode(words(F.col(text))).alias("w")).join(known, "w", "left_semi").groupBy("id", "w").agg(F.count("*").alias("n"))
    scored = held.join(asked, "w").groupBy("query_id", "id").agg(F.sum("n").alias("n"))
    scored = scored.select("query_id", "id", F.round(F.col("n") * 0.1, 6).alias("lscore"))
    return ranked(scored, "query_id", F.desc("lscore"), "id", most=limit)


def trigram_similarity(queries: DataFrame, corpus: DataFrame, query_text: str = "q", text: str = "text") -> DataFrame:
    """query_id, id, similarity of all pairs that share a trigram: common by all distinct trigrams."""
    held = corpus.select("id", tx.trigrams(F.col(text)).alias("t"))
    asked = queries.select("query_id", tx.trigrams(F.col(query_text)).alias("t"))
    a = held.select("id", F.size("t").alias("n"), F.explode("t").alias("g"))
    b = asked.select("query_id", F.size("t").alias("m"), F.explode("t").alias("g"))
    both = a.join(b, "g").groupBy("query_id", "id", "n", "m").agg(F.count("*").alias("c"))
    return both.select("query_id", "id", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("similarity"))


def trigram_relaxed(similar: DataFrame, requested: float, applied: float | None = None) -> DataFrame:
    """query_id, used_limit: the first limit of the ladder with a match, at the floor or below.

    The limits run from the requested one down; the search stops at the first that finds
    something once it is at or under min(limit, 0.05), else at the last that found something.
    """
    limits = [requested, requested if applied is None else applied, min(requested, 0.10), *LADDER[1:]]
    limits = list(dict.fromkeys(x for x in limits if x <= requested))
    best = similar.groupBy("query_id").agg(F.max("similarity").alias("best"))
    picked = None
    for x in limits:
        picked = F.when(F.col("best") >= x, x) if picked is None else picked.when(F.col("best") >= x, x)
    return best.select("query_id", "best", picked.cast("double").alias("used_limit"))


def fused(vector: DataFrame, lexical_: DataFrame, alpha: float, k: int) -> DataFrame:
    """query_id, id, vrank, lrank, fused: weighted reciprocal ranks, scaled so that rank 1 counts 1.

    vector and lexical_: query_id, id, rank. If only one leg has rows for a query, it weighs 1.
    """
    v = vector.select("query_id", "id", F.col("rank").alias("vrank"))
    x = lexical_.select("query_id", "id", F.col("rank").alias("lrank"))
    legs = Window.partitionBy("query_id")
    both = v.join(x, ["query_id", "id"], "full_outer")
    both = both.withColumn("has_v", F.max(F.col("vrank").isNotNull()).over(legs)).withColumn("has_l", F.max(F.col("lrank").isNotNull()).over(legs))
    part = lambda rank, w: F.coalesce(w / (k + F.col(rank)) * (k + 1), F.lit(0.0))
    wv = F.when(F.col("has_l"), alpha).otherwise(1.0)
    wl = F.when(F.col("has_v"), 1 - alpha).otherwise(1.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), part("vrank", wv) + part("lrank", wl)))
    return both.select("query_id", "id", "vrank", "lrank", F.round(score, 9).alias("fused"))


def first_seen() -> list[Column]:
    """Fused order: best first; vector rows before lexical ones of the same score, then by id."""
    return [F.desc("fused"), F.asc_nulls_last("vrank"), F.asc_nulls_last("lrank"), F.asc("id")]


def cutoff(fused_: DataFrame, min_sim: float, top_k: int, promote: Column | None = None) -> DataFrame:
    """The top_k rows at or above min_sim; where `promote` holds, the best below fill up (flag cutoff_fallback)."""
    below = F.col("fused") < min_sim
    rows = fused_.where(~below | (F.lit(False) if promote is None else promote))
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(below, *first_seen()))).where(F.col("rank") <= top_k)
    return out.withColumn("cutoff_fallback", below)


def hybrid_search(queries: DataFrame, corpus: DataFrame, params: HybridParams | None = None) -> DataFrame:
    """queries (query_id, q, v) against corpus (id, text, v): the ranked hits of each query.

    Both legs are cut to their limits before they meet; texts aren't carried along.
    """
    p = (params or HybridParams()).clamped()
    vec = vectors.top_k(queries.select("query_id", F.col("v").alias("q")), corpus.select("id", "v"), p.vec_limit)
    lex = lexical(queries.select("query_id", "q"), corpus.select("id", "text"), p.lex_limit)
    return cutoff(fused(vec, lex, p.alpha, p.rrf_k), p.min_sim, p.top_k)


def deleted_matches_blocked(all_vec: DataFrame, all_lex: DataFrame, seen: DataFrame) -> DataFrame:
    """query_id, blocked: distinct hits without the visibility filter less those with it."""
    total = all_vec.select("query_id", "id").union(all_lex.select("query_id", "id")).groupBy("query_id").agg(F.countDistinct("id").alias("total"))
    n = seen.groupBy("query_id").agg(F.count("*").alias("n"))
    return total.join(n, "query_id", "left").select("query_id", F.greatest(F.lit(0), F.col("total") - F.coalesce("n", F.lit(0))).alias("blocked"))


def best_of(matches: DataFrame, key: Column, *tie) -> DataFrame:
    """One row of each key: the highest score, the first of equals."""
    w = Window.partitionBy("_key").orderBy(F.desc("score"), *tie)
    return matches.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def node_key(chunk_id: Column, hash_: Column, id_: Column, text: Column) -> Column:
    """Key of a match in a node: chunk id, else hash, else id and text."""
    return F.coalesce(F.concat(F.lit("c:"), chunk_id), F.concat(F.lit("h:"), hash_), F.concat_ws("|", F.lit("i"), id_, text))


def graph_key(chunk_id: Column, document_id: Column, hash_: Column, id_: Column, source: Column, text: Column) -> Column:
    """Key of a match in the retrieval graph: another order, and 80 characters of text at last."""
    return F.coalesce(chunk_id, document_id, hash_, id_, source, F.substring(text, 1, 80))


def extended(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """base and the rows of extra whose key it lacks, one for each key."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti").dropDuplicates([key]).select(*base.columns))


def semantic_cache(queries: DataFrame, cache: DataFrame, now: Column, threshold: float = 0.9, ttl: int = 3600, most: int = 200) -> DataFrame:
    """query_id, entry, similarity: the most similar live entry of a query's scope.

    queries: query_id, scope, q; cache: entry, scope, v, created (timestamp). Of a scope only
    the newest `most` entries count.
    """
    live = ranked(cache, "scope", F.desc("created"), F.desc("entry"), most=most).where(F.unix_timestamp(now) - F.unix_timestamp("created") <= ttl)
    scored = queries.join(live, "scope").select("query_id", "entry", F.round(vectors.cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    return ranked(scored.where(F.col("similarity") >= threshold), "query_id", F.desc("similarity"), "entry", most=1).drop("rank")
