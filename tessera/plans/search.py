"""Queries over search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rank as rk
from ..operators import search as se
from .registry import query

W = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+')"
LEX = f"""asked AS (SELECT item_id AS query_id, unnest(list_distinct({W})) AS w FROM benchmark WHERE item_id % 20 = 0),
held AS (SELECT doc_id AS id, w, count(*) AS n FROM (SELECT doc_id, unnest({W}) AS w FROM documents) GROUP BY ALL),
lex AS (SELECT query_id, id, lscore, row_number() OVER (PARTITION BY query_id ORDER BY lscore DESC, id)::int AS rank FROM
  (SELECT query_id, id, round(sum(n) * 0.1, 6)::double AS lscore FROM held JOIN asked USING (w) GROUP BY query_id, id))"""
VEC = """vec AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::int AS rank FROM
  (SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) AS distance
   FROM embeddings q, embeddings c JOIN documents d ON d.doc_id = c.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)))"""
FUSED = f"""WITH {LEX}, {VEC},
fused AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, v.rank AS vrank, l.rank AS lrank,
  round(least(1.0, coalesce(0.7 / (60 + v.rank) * 61, 0) + coalesce(0.3 / (60 + l.rank) * 61, 0)), 9)::double AS fused
  FROM (SELECT * FROM vec WHERE rank <= 50) v FULL JOIN (SELECT * FROM lex WHERE rank <= 50) l ON v.query_id = l.query_id AND v.id = l.id)"""


def inputs(t):
    """benchmark items with the vectors of their ids as queries; documents with theirs as corpus."""
    v = t.embeddings.select(F.col("vec_id"), F.col("embedding").alias("v"))
    queries = t.benchmark.where("item_id % 20 = 0").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), "v")
    corpus = t.documents.select("doc_id", "text").join(v, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("id"), "text", "v")
    return queries, corpus


def legs(t, n=50):
    from ..functions import vectors

    queries, corpus = inputs(t)
    return vectors.top_k(queries.select("query_id", F.col("v").alias("q")), corpus.select("id", "v"), n), se.lexical(queries, corpus, n)


@query("lexical_or_topk", f"WITH {LEX} SELECT * FROM lex WHERE rank <= 50")
def _(t):
    return legs(t)[1]


@query("hybrid_rrf", FUSED + " SELECT * FROM fused")
def hybrid(t):
    vec, lex = legs(t)
    return se.fused(vec, lex, 0.7, 60)


ORDER = "fused DESC, vrank NULLS LAST, lrank NULLS LAST, id"


@query("hybrid_search", FUSED + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER})::int AS rank, false AS cutoff_fallback FROM fused WHERE fused >= 0.15) WHERE rank <= 5")
def hybrid_search(t):
    return se.hybrid_search(*inputs(t))


@query("hybrid_cutoff_fallback", FUSED + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused < 0.99, {ORDER})::int AS rank, fused < 0.99 AS cutoff_fallback FROM fused) WHERE rank <= 5")
def _(t):
    return se.cutoff(hybrid(t), 0.99, 5, promote=F.lit(True))


@query("source_mix", FUSED + " SELECT query_id, count(*) FILTER (WHERE lrank IS NULL) AS vector_only, count(*) FILTER (WHERE vrank IS NULL) AS lexical_only, count(*) FILTER (WHERE lrank IS NOT NULL AND vrank IS NOT NULL) AS both_legs FROM fused GROUP BY query_id")
def _(t):
    v, x = F.col("vrank").isNotNull(), F.col("lrank").isNotNull()
    return hybrid(t).groupBy("query_id").agg(F.count_if(v & ~x).alias("vector_only"), F.count_if(x & ~v).alias("lexical_only"), F.count_if(v & x).alias("both_legs"))


@query("deleted_matches_blocked", FUSED + " SELECT query_id, count(DISTINCT id) - count(DISTINCT CASE WHEN id % 10 <> 0 THEN id END) AS blocked FROM fused GROUP BY query_id")
def _(t):
    vec, lex = legs(t)
    seen = vec.select("query_id", "id").union(lex.select("query_id", "id")).distinct().where("id % 10 <> 0")
    return se.deleted_matches_blocked(vec, lex, seen)


TG = r"list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = f"""WITH a AS (SELECT item_id AS id, t, len(t) AS n FROM (SELECT item_id, {TG} AS t FROM benchmark)),
b AS (SELECT query_id, t, len(t) AS m FROM (SELECT conv_id * 1000 + turn AS query_id, {TG} AS t FROM conversations WHERE conv_id % 20 = 0)),
sim AS (SELECT query_id, id, round(c / (n + m - c), 6) AS similarity FROM (SELECT b.query_id, a.id, a.n, b.m, count(*) AS c FROM (SELECT id, n, unnest(t) AS g FROM a) a JOIN (SELECT query_id, m, unnest(t) AS g FROM b) b USING (g) GROUP BY ALL))"""


def similar(t):
    asked = t.conversations.where("conv_id % 20 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("q"))
    return se.trigram_similarity(asked, t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("trigram_topk", SIM + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::int AS rank FROM sim) WHERE rank <= 10")
def _(t):
    return se.ranked(similar(t), "query_id", F.desc("similarity"), "id", most=10)


@query("trigram_relax_limit", SIM + " SELECT query_id, best, CASE " + " ".join(f"WHEN best >= {x} THEN {x}" for x in [0.3, *se.LADDER]) + " END::double AS used_limit FROM (SELECT query_id, max(similarity) AS best FROM sim GROUP BY query_id)")
def _(t):
    return se.trigram_relaxed(similar(t), 0.3)


@query("multi_query_dedupe", FUSED + " SELECT id, max(fused) AS score, arg_min(query_id, (-fused, query_id)) AS query_id FROM fused GROUP BY id")
def _(t):
    m = hybrid(t).select("query_id", "id", F.col("fused").alias("score"))
    return se.best_of(m, F.col("id"), "query_id").select("id", "score", "query_id")


@query("match_keys", "SELECT k AS match_key, max(n_chars) AS score, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'c:' || doc_id WHEN doc_id % 3 = 1 THEN 'h:' || md5(text) ELSE 'i|' || source || '|' || text END AS k, n_chars FROM documents) GROUP BY k")
def _(t):
    m = F.col("doc_id") % 3
    key = se.node_key(F.when(m == 0, F.col("doc_id").cast("string")), F.when(m == 1, F.md5("text")), F.col("source"), F.col("text"))
    return t.documents.select(key.alias("match_key"), "n_chars").groupBy("match_key").agg(F.max("n_chars").alias("score"), F.count("*").alias("n"))


@query("graph_match_dedupe", "SELECT k AS match_key, max(n_chars) AS score FROM (SELECT coalesce(CASE WHEN doc_id % 4 = 0 THEN 'x' || doc_id END, CASE WHEN doc_id % 4 = 1 THEN source END, substr(text, 1, 80)) AS k, n_chars FROM documents) GROUP BY k")
def _(t):
    m, none = F.col("doc_id") % 4, F.lit(None).cast("string")
    key = se.graph_key(F.when(m == 0, F.concat(F.lit("x"), "doc_id")), F.when(m == 1, F.col("source")), none, none, none, F.col("text"))
    d = se.best_of(t.documents.withColumnRenamed("n_chars", "score").withColumn("match_key", key), F.col("match_key"), "doc_id")
    return d.select("match_key", "score")


@query("neighbour_union", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(t):
    d = t.documents.select("doc_id")
    return se.extended(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0").union(d.where("doc_id % 6 = 0")), "doc_id")


@query("semantic_cache", """WITH c AS (SELECT vec_id AS entry, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings WHERE vec_id % 20 <> 0)
 SELECT query_id, entry, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry) AS k FROM (SELECT q.vec_id AS query_id, c.entry, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) AS similarity
 FROM embeddings q JOIN c USING (label) WHERE q.vec_id % 20 = 0 AND c.r <= 200 AND 500 - c.entry <= 300) WHERE similarity >= 0.2) WHERE k = 1""")
def _(t):
    e = t.embeddings
    cache = e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("entry"), F.col("label").alias("scope"), F.col("embedding").alias("v"), F.timestamp_seconds("vec_id").alias("created"))
    return se.semantic_cache(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("q")), cache, F.timestamp_seconds(F.lit(500)), 0.2, 300)


def matches(t):
    """Turns of a conversation as one query's matches: role is the section, scores fall with the turn."""
    c = t.conversations
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.lit(1).alias("doc"), F.col("role").alias("section"), F.col("turn").alias("ord"), F.round(1 / (1 + F.length("text") % 7), 6).alias("score"), "text")


FEATURES = r"""WITH m AS (SELECT conv_id AS query_id, turn AS id, role AS section, turn AS ord, round(1.0::double / (1 + length(text) % 7), 6) AS score, (length(text) % 10) / 10.0::double AS density FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY ord, id) AS place, first_value(id) OVER (PARTITION BY query_id ORDER BY score DESC, ord, id) AS aid FROM m),
a AS (SELECT query_id, id AS aid, section AS asec, place AS aplace FROM p WHERE id = aid)
SELECT query_id, id, round(0.2 * 0.5 + 0.2 * (section = asec)::int + 0.3 * score + 0.2 * (section = asec AND abs(place - aplace) = 1)::int + 0.1 * (id % 2 = 0)::int, 6)::double AS weighted_score, (section = asec)::int::double AS section_match FROM p JOIN a USING (query_id, aid)"""


@query("rerank_features", FEATURES)
def _(t):
    m = matches(t).select("*", F.lit(0.5).alias("parent_relevance"), F.when(F.col("id") % 2 == 0, "policy").alias("doc_type"), F.lit("policy").alias("want_type"), ((F.length("text") % 10) / 10.0).alias("density"))
    return rk.rerank_features(m).select("query_id", "id", F.round("weighted_score", 6).alias("weighted_score"), "section_match")


@query("rerank", """WITH m AS (SELECT conv_id AS query_id, turn AS id, round(1.0::double / (1 + length(text) % 7), 6) AS score, (length(text) % 10) / 10.0::double AS density, turn % 4 = 1 AS prim FROM conversations),
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM m), q AS (SELECT *, round(score + 0.15 * density, 6) AS final, sum(prim::int) OVER (PARTITION BY query_id) AS n FROM p WHERE r <= 20)
 SELECT query_id, id, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prim DESC, CASE WHEN prim THEN id END, final DESC, id)::int AS rank FROM q) WHERE rank <= greatest(3, n)""")
def _(t):
    m = matches(t).select("query_id", "id", "score", ((F.length("text") % 10) / 10.0).alias("density"), (F.col("id") % 4 == 1).alias("is_primary"), F.col("id").alias("chunk_index"), F.lit(False).alias("is_neighbour"))
    return rk.reranked(m, 3, extract=True).select("query_id", "id", "final", "rank")


@query("rerank_order", "SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 2 = 1 THEN -turn END NULLS LAST, turn)::int AS rank FROM conversations")
def _(t):
    base = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("turn").alias("base_rank"))
    ranking = base.where("id % 2 = 1").select("query_id", "id", (-F.col("id")).alias("position")).union(base.select("query_id", F.lit(999).alias("id"), F.lit(0).alias("position")))
    return rk.applied_order(base, ranking).select("query_id", "id", "rank")


def tokenized(t):
    return matches(t).withColumn("tokens", tx.dedup_tokens(F.col("text"))).withColumn("host", F.col("section"))


@query("mmr")
def _(t):
    return rk.mmr(tokenized(t).withColumn("doc", F.col("id")).select("query_id", "id", "doc", "score", "tokens"), 4)


@query("mmr_light")
def _(t):
    return rk.mmr_light(tokenized(t).select("query_id", "id", "host", "score", "tokens"), 4)


@query("context_budget", "SELECT * FROM (SELECT conv_id AS query_id, turn AS rank, greatest(1, length(text) // 4)::int AS tokens, sum(greatest(1, length(text) // 4)::int) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS used_tokens FROM conversations WHERE length(text) > 0) WHERE used_tokens <= 100")
def _(t):
    s = t.conversations.where("length(text) > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), tx.tokens_quarter(F.col("text")).alias("tokens"))
    return rk.within_budget(s, 100)


CONF = "SELECT query_id, round(s[1], 6) AS top, round(CASE WHEN len(s) < 2 THEN s[1] ELSE s[1] - s[len(s)] END, 6) AS delta FROM (SELECT conv_id AS query_id, list_slice(list(1.0::double / (1 + length(text) % 7) ORDER BY 1.0::double / (1 + length(text) % 7) DESC), 1, 3) AS s FROM conversations GROUP BY conv_id)"


@query("confidence_metrics", CONF)
def _(t):
    return rk.confidence(t.conversations.select(F.col("conv_id").alias("query_id"), (1 / (1 + F.length("text") % 7)).alias("score")))


@query("confidence_retry", f"SELECT query_id, top < 0.65 OR delta < 0.05 AS retry, 0.075::double AS min_sim, 7 AS top_k, 210 AS max_candidates FROM ({CONF})")
def _(t):
    c = rk.confidence(t.conversations.select(F.col("conv_id").alias("query_id"), (1 / (1 + F.length("text") % 7)).alias("score")))
    return rk.retry_params(c, 0.15, 5, 200)


@query("web_heuristics", r"""SELECT page_id, round(greatest(0.0, least(100.0, CASE WHEN contains(title, 'the') THEN 30.0 ELSE 0.0 END + least(words / 20.0, 25.0) + least((length(snip) - length(replace(snip, 'the', ''))) / 3 * 10.0, 20.0)
  - CASE WHEN regexp_matches(url, 'login|signup|register|cookie-policy|privacy-policy') THEN 20.0 ELSE 0.0 END + CASE WHEN page_id % 6 < 3 THEN 5.0 ELSE 0.0 END)), 6)::double AS score
  FROM (SELECT page_id, lower(url) AS url, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS title, lower(html) AS snip, len(list_filter(regexp_split_to_array(trim(lower(html)), '\s+'), lambda w: w <> '')) AS words FROM pages)""")
def _(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    s = rk.web_heuristics(title, F.col("html"), F.col("url"), F.col("page_id") % 6, F.lit("the"))
    return t.pages.select("page_id", F.round(s, 6).alias("score"))


@query("web_scores", "SELECT page_id, round(0.6 * 100 * 0.5 + 0.4 * (page_id % 100), 6)::double AS blended, round(60 - 2 * (page_id % 9) + greatest(0.0, 30 - (page_id % 500) / 12.0) + CASE WHEN page_id % 2 = 0 THEN 10 ELSE 0 END, 6)::double AS fallback, round(1.0::double/(90 + page_id % 9) + CASE WHEN page_id % 3 = 0 THEN 1.0::double/91 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 1.0::double/91 ELSE 1.0::double/92 END + CASE page_id % 4 WHEN 0 THEN 0.7/90.5 WHEN 1 THEN -0.7/90.5 ELSE 0 END, 9)::double AS fused FROM pages")
def _(t):
    i = F.col("page_id")
    policy = F.when(i % 4 == 0, "boost").when(i % 4 == 1, "reject")
    return t.pages.select("page_id", F.round(rk.blended(F.lit(0.5), i % 100), 6).alias("blended"), F.round(rk.fallback_score(i % 9, i % 500, F.when(i % 2 == 0, "high")), 6).alias("fallback"), F.round(rk.final_fusion(i % 9, i % 3 == 0, i % 5 == 0, policy, F.lit(70.0)), 9).alias("fused"))


@query("diverse_top", """WITH s AS (SELECT conv_id AS query_id, turn AS id, role AS bucket, length(text) AS score FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, id) AS b FROM s),
 l AS (SELECT *, CASE WHEN b = 1 THEN row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN b = 1 THEN 0 ELSE 1 END, score DESC, id) END AS lead_ FROM b)
 SELECT query_id, id, bucket, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lead_ <= 2 THEN 0 ELSE 1 END, score DESC, id)::int AS rank FROM l) WHERE rank <= 3""")
def _(t):
    s = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("role").alias("bucket"), F.length("text").cast("long").alias("score"))
    return rk.diverse(s, 3, 2)


@query("candidate_filter", """WITH c AS (SELECT source AS query_id, doc_id AS id, md5(text) AS k, doc_id % 7 = 0 AS rej, doc_id % 5 = 0 AS stale, text FROM documents),
 r AS (SELECT query_id, id, CASE WHEN rej THEN 'policy_block' WHEN row_number() OVER (PARTITION BY query_id, k ORDER BY id) > 1 THEN 'duplicate' WHEN trim(text) = '' THEN 'empty_snippet' WHEN stale THEN 'stale' END AS reason FROM c)
 SELECT query_id, id, reason, CASE WHEN max((reason IS NULL)::int) OVER (PARTITION BY query_id) = 1 THEN reason IS NULL ELSE coalesce(reason <> 'policy_block', true) END AS kept FROM r""")
def _(t):
    c = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.md5("text").alias("url_key"), F.col("text").alias("snippet"))
    return rk.candidate_flags(c, F.col("id") % 7 == 0, F.col("id") % 5 == 0).select("query_id", "id", "reason", "kept")


@query("component_top", "SELECT * FROM (SELECT component, doc_id AS id, score, row_number() OVER (PARTITION BY component ORDER BY score DESC, doc_id)::int AS rank FROM (SELECT component, doc_id, round(1.0::double / (1 + doc_id % 50) + 0.05 * len(list_filter(words, lambda w: contains(lower(text), w))), 6) AS score FROM documents, (VALUES ('locations', ['the', 'and', 'der']), ('scope', ['que', 'la'])) c(component, words))) WHERE rank <= 10")
def _(t):
    comps = t.spark.createDataFrame([("locations", ["the", "and", "der"]), ("scope", ["que", "la"])], "component string, words array<string>")
    return rk.component_top(comps, t.documents.select(F.col("doc_id").alias("id"), "text", (1 / (1 + F.col("doc_id") % 50)).alias("score")))
