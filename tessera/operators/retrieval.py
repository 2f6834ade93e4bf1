"""Retrieval as a whole: variants of a query, scoped search of each, one list of matches, confidence, another round, reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stages import cut
from . import rank as rk
from . import scoped as sc
from . import search as se

# What is put behind a query, at first and when it is asked again.
FIRST = ["overview", "key facts", "definition", "requirements"]
AGAIN = ["overview", "background", "general principles", "summary"]


def distinct_texts(texts: Column, most: int) -> Column:
    """The first `most` texts of an array that aren't blank, trimmed; of those that differ in case only, the first."""
    trimmed = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != "")
    keep = lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.concat(out, F.array(t)))
    return F.slice(F.aggregate(trimmed, F.array().cast("array<string>"), keep), 1, most)


def variants(query: Column, again: bool = False) -> Column:
    """A query and what it is asked as besides: three texts at most, five when it is asked again. None for a blank query."""
    base = F.trim(query)
    put = lambda words: [F.concat(base, F.lit(f" {w}")) for w in words]
    first = distinct_texts(F.array(base, *put(FIRST)), 3)
    all_ = distinct_texts(F.concat(first, F.array(base, *put(AGAIN))), 5) if again else first
    return F.when(base != "", all_).otherwise(F.array().cast("array<string>"))


def query_plan(queries: DataFrame) -> DataFrame:
    """query_id, queries, doc_type, must_include, collections, document_ids: how a query is asked, and what binds it.

    queries: query_id, q, doc_class, must_include (array), filter_collection, context_collection,
    document_id. The type is the given class, or what the words say; it is put behind the query.
    """
    kind = F.coalesce(F.when(F.trim("doc_class") != "", F.trim("doc_class")), tx.doc_type(F.col("q")))
    asked = F.array_compact(F.array(F.col("q"), F.concat("q", F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")))))
    listed = lambda *c: distinct_texts(F.array_compact(F.array(*c)), 1000)
    return queries.select(
        "query_id", distinct_texts(asked, 1000).alias("queries"), kind.alias("doc_type"), F.filter(F.transform(F.coalesce("must_include", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "").alias("must_include"),
        listed("filter_collection", "context_collection").alias("collections"), listed("document_id").alias("document_ids"),
    )


@dataclass
class Retrieved:
    """matches: query_id, id, score, variants (those that found it), round, rank. conduct: query_id, round, top, delta, again."""

    matches: DataFrame
    conduct: DataFrame


def merged(hits: DataFrame, most: int) -> DataFrame:
    """One row for each query and chunk: the best score of its variants, which all stay noted, cut to the best."""
    one = hits.groupBy("query_id", "id").agg(F.max("fused").alias("score"), F.array_sort(F.collect_set("variant")).alias("variants"))
    return se.ranked(one, "query_id", F.desc("score"), "id", most=most)


def retrieve(queries: DataFrame, chunks: DataFrame, params: se.HybridParams | None = None, retries: int = 1, embed: Callable[[Column], Column] | None = None, **how) -> Retrieved:
    """queries and chunks as of scoped.hybrid_search(); `how` is passed on to it.

    Queries whose matches are too weak, or too close to each other, are asked again with more
    variants, a lower cutoff and more candidates, up to `retries` times; the others leave. What
    the last round of a query found counts. embed makes the vector of a variant; without it the
    variants share the query's.
    """
    p = (params or se.HybridParams()).clamped()
    active, found, conduct = queries, [], []
    for n in range(retries + 1):
        told = active.withColumn("_v", variants(F.col("q"), n > 0)).select("*", F.posexplode("_v").alias("variant", "_q")).drop("_v")
        told = told.withColumns({"q": F.col("_q"), "query_id": F.struct("query_id", "variant")}).drop("_q", "variant")
        if embed is not None:
            told = told.withColumn("v", embed(F.col("q")))
        wider = se.HybridParams(min(p.top_k + 2 * n, 2 * p.top_k), p.alpha, p.min_sim * 0.5**n, p.vec_limit, p.lex_limit, p.trgm_limit, min(p.max_candidates + 10 * n, 2 * p.max_candidates), p.rrf_k)
        hits = sc.hybrid_search(told, chunks, wider, report=False, **how).hits.select("query_id.query_id", "query_id.variant", "id", "fused")
        matches = cut(merged(hits, wider.clamped().top_k))
        conf = active.select("query_id").join(rk.confidence(matches), "query_id", "left").fillna(0.0, ["top", "delta"])
        low = cut(conf.select("query_id", F.lit(n).alias("round"), "top", "delta", (((F.col("top") < 0.65) | (F.col("delta") < 0.05)) & F.lit(n < retries)).alias("again")))
        again = low.where("again").select("query_id")
        found.append(matches.join(again, "query_id", "left_anti").withColumn("round", F.lit(n)))
        conduct.append(low)
        if n == retries or again.isEmpty():
            break
        active = cut(active.join(again, "query_id", "left_semi"))
    all_matches, all_conduct = found[0], conduct[0]
    for m, c in zip(found[1:], conduct[1:], strict=True):
        all_matches, all_conduct = all_matches.unionByName(m), all_conduct.unionByName(c)
    return Retrieved(all_matches, all_conduct)


def primary_document(matches: DataFrame, least: int = 2) -> DataFrame:
    """query_id, doc: the document of the best match among those with `least` matches or more. matches: query_id, doc, rank."""
    hits = matches.where("doc is not null").withColumn("_n", F.count("*").over(Window.partitionBy("query_id", "doc")))
    return hits.where(F.col("_n") >= least).groupBy("query_id").agg(F.min_by("doc", "rank").alias("doc"))


def answered(queries: DataFrame, chunks: DataFrame, top_k: int = 3, extract: bool = False, **how) -> DataFrame:
    """query_id, id, score, final, rank, round: retrieve() and its matches reranked, the primary document's first.

    chunks have a document_id and an ord too.
    """
    got = retrieve(queries, chunks, **how).matches.withColumnRenamed("rank", "found_rank")
    m = got.join(chunks.select("id", F.col("document_id").alias("doc"), "ord", tx.question_density(F.col("text")).alias("density")), "id")
    lead = primary_document(m.withColumnRenamed("found_rank", "rank")).withColumnRenamed("doc", "_lead")
    m = m.join(lead, "query_id", "left").withColumns({"is_primary": F.coalesce(F.col("doc") == F.col("_lead"), F.lit(False)), "chunk_index": F.col("ord"), "is_neighbour": F.lit(False)})
    return rk.reranked(m, top_k, extract=extract).select("query_id", "id", "score", "final", "rank", "round", "variants")
