"""Queries over scoped search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probe as pr
from ..operators import scoped as sc
from ..operators import search as se
from .registry import query
from .search import TG, W

#: Documents as chunks: the language is the tenant, the source the case.
CHUNKS = """chunks AS (SELECT doc_id AS id, text, embedding, lang AS tenant_id, source AS case_id, 'c' || doc_id % 5 AS collection_id, 'c' || doc_id % 7 AS doc_class, CASE WHEN doc_id % 10 = 0 THEN 'deleted' END AS lifecycle,
  CASE WHEN doc_id % 15 = 1 THEN 'retired' END AS lifecycle_state, CASE doc_id % 4 WHEN 3 THEN 'false' WHEN 2 THEN 'true' END AS is_latest FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
#: First turns of the conversations whose id is divisible by 20, each with a scope of its own.
ASKED = """asked AS (SELECT conv_id AS query_id, text AS q, embedding AS v, (['en', 'fr', 'de', 'es'])[1 + conv_id // 20 % 4] AS tenant_id, CASE WHEN conv_id // 20 % 3 = 0 THEN 'src' || conv_id // 20 % 20 END AS case_id,
  CASE WHEN conv_id // 20 % 3 < 2 THEN ['c1', 'c3'] END AS collection_ids, CASE WHEN conv_id // 20 % 5 = 4 THEN 'all' WHEN conv_id // 20 % 5 = 3 THEN 'deleted' ELSE 'active' END AS visibility FROM conversations LEFT JOIN embeddings ON vec_id = conv_id WHERE turn = 0 AND conv_id % 20 = 0)"""
ACTIVE = "(coalesce(lifecycle, 'active') = 'active' AND coalesce(lifecycle_state, 'active') = 'active')"


def scope(shown: str) -> str:
    cases = "a.case_id IS NULL AND a.collection_ids IS NULL OR coalesce(c.case_id = a.case_id, false) OR coalesce(list_contains(a.collection_ids, c.collection_id), false)"
    return f"c.tenant_id = a.tenant_id AND coalesce(c.is_latest, 'true') = 'true' AND ({cases}) AND {shown}"


SHOWN = f"CASE a.visibility WHEN 'all' THEN true WHEN 'deleted' THEN NOT {ACTIVE} ELSE {ACTIVE} END"


def leg_sql(shown: str, tag: str) -> str:
    return f"""pairs{tag} AS (SELECT a.query_id, a.q, a.v, c.* FROM asked a JOIN chunks c ON {scope(shown)}),
vec{tag} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS vrank FROM (SELECT query_id, id, round(1 - list_cosine_similarity(v::double[], embedding::double[]), 6) AS d FROM pairs{tag} WHERE v IS NOT NULL AND embedding IS NOT NULL) QUALIFY vrank <= 50),
lex{tag} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS lrank FROM (SELECT p.query_id, p.id, round(sum(n) * 0.1, 6) AS s FROM pairs{tag} p JOIN held h ON h.id = p.id JOIN words w ON w.query_id = p.query_id AND w.w = h.w GROUP BY 1, 2) QUALIFY lrank <= 50)"""


HELD = f"""words AS (SELECT query_id, unnest(list_distinct({W.replace('text', 'q')})) AS w FROM asked), held AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({W}) AS w FROM chunks) GROUP BY ALL)"""
FUSED = f"""WITH {CHUNKS}, {ASKED}, {HELD}, {leg_sql(SHOWN, '')},
f AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, vrank, lrank, max((vrank IS NOT NULL)::int) OVER w AS hv, max((lrank IS NOT NULL)::int) OVER w AS hl FROM vec v FULL JOIN lex l ON v.query_id = l.query_id AND v.id = l.id WINDOW w AS (PARTITION BY coalesce(v.query_id, l.query_id))),
fused AS (SELECT query_id, id, vrank, lrank, round(least(1.0, coalesce(CASE hl WHEN 1 THEN 0.7 ELSE 1 END / (60 + vrank) * 61, 0) + coalesce(CASE hv WHEN 1 THEN 0.3 ELSE 1 END / (60 + lrank) * 61, 0)), 9)::double AS fused FROM f),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vrank NULLS LAST, lrank NULLS LAST, id) AS rank FROM fused WHERE fused >= 0.15 QUALIFY rank <= 5)"""


def chunks(t):
    i = F.col("doc_id")
    d = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), "doc_id", "left")
    return d.select(
        i.alias("id"), "text", "v", F.col("lang").alias("tenant_id"), F.col("source").alias("case_id"), F.concat(F.lit("c"), i % 5).alias("collection_id"), F.concat(F.lit("c"), i % 7).alias("doc_class"),
        F.when(i % 10 == 0, "deleted").alias("lifecycle"), F.when(i % 15 == 1, "retired").alias("lifecycle_state"), F.when(i % 4 == 3, "false").when(i % 4 == 2, "true").alias("is_latest"),
    )


def asked(t):
    k = F.floor(F.col("conv_id") / 20).cast("int")
    c = t.conversations.where("turn = 0 and conv_id % 20 = 0").join(t.embeddings.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("v")), "conv_id", "left")
    return c.select(
        F.col("conv_id").alias("query_id"), F.col("text").alias("q"), "v", F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), k % 4 + 1).alias("tenant_id"), F.when(k % 3 == 0, F.concat(F.lit("src"), k % 20)).alias("case_id"),
        F.when(k % 3 < 2, F.array(F.lit("c1"), F.lit("c3"))).alias("collection_ids"), F.when(k % 5 == 4, "all").when(k % 5 == 3, "deleted").otherwise("active").alias("visibility"),
    )


@query("scoped_hybrid_search", FUSED + " SELECT query_id, id, vrank::int AS vrank, lrank::int AS lrank, fused, rank::int AS rank FROM hits")
def _(t):
    return sc.hybrid_search(asked(t), chunks(t), report=False).hits.select("query_id", "id", "vrank", "lrank", "fused", "rank")


REPORT = FUSED + f""", {leg_sql('true', '_any')},
 n AS (SELECT query_id, visibility, v IS NULL AS query_embedding_empty, (SELECT count(*) FROM vec WHERE vec.query_id = asked.query_id) AS vector_candidates, (SELECT count(*) FROM lex WHERE lex.query_id = asked.query_id) AS lexical_candidates,
  (SELECT count(*) FROM fused WHERE fused.query_id = asked.query_id) AS fused_candidates, (SELECT count(*) FROM fused WHERE fused.query_id = asked.query_id AND fused < 0.15) AS below_cutoff, (SELECT count(*) FROM hits WHERE hits.query_id = asked.query_id) AS returned_after_cutoff,
  CASE WHEN visibility = 'active' THEN (SELECT count(DISTINCT id) FROM (SELECT query_id, id FROM vec_any UNION ALL SELECT query_id, id FROM lex_any) x WHERE x.query_id = asked.query_id) END AS cached_total_candidates FROM asked)
 SELECT *, coalesce(greatest(0, cached_total_candidates - vector_candidates - lexical_candidates), 0) AS deleted_matches_blocked FROM n"""


@query("scoped_search_report", REPORT)
def _(t):
    r = sc.hybrid_search(asked(t), chunks(t)).report
    return r.select("query_id", "visibility", "query_embedding_empty", "vector_candidates", "lexical_candidates", "fused_candidates", "below_cutoff", "returned_after_cutoff", "cached_total_candidates", "deleted_matches_blocked")


#: Turns by trigrams: a turn is asked for among those of another role and of a case; similarities of all pairs in scope.
TURNS = f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, role AS tenant_id, {TG} AS u, CASE WHEN conv_id % 9 = 0 THEN 'deleted' END AS lifecycle FROM conversations),
a AS (SELECT conv_id * 1000 + turn AS query_id, CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END AS tenant_id, {TG} AS t FROM conversations WHERE conv_id % 20 = 0 AND trim(text) <> ''),
s AS (SELECT query_id, id, round(len(list_intersect(t, u)) / greatest(1, len(t) + len(u) - len(list_intersect(t, u))), 6) AS s, len(t) AS m, len(u) AS n FROM a JOIN c USING (tenant_id) WHERE lifecycle IS NULL)"""


def turns(t):
    c, key = t.conversations, (F.col("conv_id") * 1000 + F.col("turn"))
    held = c.select(key.alias("id"), "text", F.col("role").alias("tenant_id"), F.when(F.col("conv_id") % 9 == 0, "deleted").alias("lifecycle"))
    q = c.where("conv_id % 20 = 0").select(key.alias("query_id"), F.col("text").alias("q"), F.when(F.col("role") == "user", "assistant").otherwise("user").alias("tenant_id"))
    return sc.prepared(q, held)


@query("trigram_limited", TURNS + " SELECT query_id, id, s AS similarity FROM s WHERE m > 0 AND s >= 0.2")
def _(t):
    q, c = turns(t)
    return sc.similar(q.withColumn("at_least", F.lit(0.2)), c, sc.seen())


def ladder_sql(first: float, tried: list[float]) -> str:
    cases = " ".join(f"WHEN best >= {x} THEN {x}" for x in tried)
    return f""", p AS (SELECT query_id, coalesce(max(s) FILTER (WHERE m > 0 AND s >= {first}), -1) AS hit, max(s) AS best FROM s GROUP BY query_id), l AS (SELECT query_id, CASE WHEN hit >= 0 THEN NULL ELSE CASE {cases} ELSE 0 END END::double AS fallback_limit FROM p)
 SELECT query_id, id, s AS lscore, fallback_limit, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::int AS rank FROM s JOIN l USING (query_id) WHERE s >= coalesce(fallback_limit, {first}) QUALIFY rank <= 20"""


@query("trigram_fallback", TURNS + ladder_sql(0.3, [x for x in se.LADDER if x <= 0.05]))
def _(t):
    return sc.trigram_leg(*turns(t), 20, sc.seen())


@query("trigram_fallback_requested", TURNS + ladder_sql(0.45, [0.45, *se.LADDER]))
def _(t):
    return sc.trigram_leg(*turns(t), 20, sc.seen(), requested=0.45)


@query("filter_spec", "SELECT doc_id FROM documents WHERE lang = 'en' AND (source = 'src3' OR doc_id % 5 IN (1, 2) OR doc_id % 7 IN (1, 2)) AND doc_id % 10 <> 0 AND doc_id % 15 <> 1 AND (doc_id % 4 <> 3)")
def _(t):
    spec = sc.FilterSpec.of({"collection_ids": ["c1 ", "c2", " "], "case_id": " ", "project": "x"}, tenant_id="en", case_id="src3")
    held = chunks(t).drop("v")
    for c in ("hash", "metadata_hash", *sc.METADATA.values()):
        held = held.withColumn(c, F.lit(None).cast("string"))
    return held.where(spec.predicate(routing=True)).select(F.col("id").alias("doc_id"))


U = "'00000000-0000-4000-8000-' || lpad(printf('%x', {0}), 12, '0')"


@query("router_scope", f"""SELECT doc_id, CASE WHEN len(ids) > 0 THEN ids END AS collection_ids, CASE doc_id % 3 WHEN 0 THEN {U.format('doc_id')} ELSE CASE doc_id % 4 WHEN 1 THEN {U.format('doc_id + 1')} END END AS collection,
  CASE WHEN doc_id % 5 = 0 THEN 'filtered' ELSE source END AS doc_class, CASE WHEN doc_id % 6 = 5 THEN 'all' ELSE 'active' END AS visibility FROM (SELECT doc_id, source,
  CASE WHEN doc_id % 3 = 0 AND NOT list_contains(asked, {U.format('doc_id')}) THEN list_prepend({U.format('doc_id')}, asked) ELSE asked END AS ids FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN [{U.format('doc_id')}, {U.format('7')}] WHEN 1 THEN [{U.format('7')}, {U.format('doc_id + 1')}] WHEN 2 THEN [{U.format('7')}] ELSE [] END AS asked FROM documents))""")  # fmt: skip
def _(t):
    i = F.col("doc_id")
    u = lambda c: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(c)), 12, "0"))
    bare = lambda c: F.concat(F.lit(" {"), F.upper(F.replace(c, F.lit("-"), F.lit(""))), F.lit("}"))
    odd = F.array(u(F.lit(7)), F.lit("nothing"), F.concat(F.lit("urn:uuid:"), u(F.lit(7))))
    r = t.documents.select(
        i, F.when(i % 4 == 0, F.array(bare(u(i)), u(F.lit(7)), F.lit(None))).when(i % 4 < 3, odd).alias("filter_collections"), F.when(i % 4 == 1, u(i + 1)).when(i % 4 == 2, "none").alias("filter_collection"), F.when(i % 3 == 0, u(i)).when(i % 3 == 1, " ").alias("collection_id"),
        F.col("source").alias("doc_class"), F.when(i % 5 == 0, " filtered ").when(i % 5 == 1, "").alias("filter_doc_class"), F.when(i % 2 == 1, " All").otherwise("deleted").alias("visibility"),
    )
    out = sc.routed(r, i % 3 == 2)
    return out.select("doc_id", F.col("collection_ids_asked").alias("collection_ids"), F.col("collection_asked").alias("collection"), F.col("doc_class_asked").alias("doc_class"), F.when(i % 2 == 1, F.col("visibility_shown")).otherwise("active").alias("visibility"))


#: Documents of five vectors each; every fourth has no scope. Centroids of those whose id is divisible by 20 ask all chunks of their scope.
PARTS = """WITH e AS (SELECT vec_id // 5 AS id, vec_id AS chunk, CASE WHEN vec_id // 5 % 4 > 0 THEN vec_id // 5 % 4 END AS scope, embedding::double[] AS v FROM embeddings),
m AS (SELECT id, any_value(scope) AS scope, list(x ORDER BY i) AS v FROM (SELECT id, scope, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) GROUP BY ALL) WHERE id % 20 = 0 GROUP BY id),
u AS (SELECT id, scope, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM m)"""


def parts(t):
    i = F.floor(F.col("vec_id") / 5)
    c = t.embeddings.select(i.alias("id"), F.col("vec_id").alias("chunk"), F.when(i % 4 > 0, i % 4).alias("scope"), F.col("embedding").alias("v"))
    return pr.document_centroids(c.where("id % 20 = 0")), c


BEST = "SELECT * FROM (SELECT id, other, chunk, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other)::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, other ORDER BY similarity DESC, chunk) AS r FROM s) WHERE r = 1) WHERE rank <= 8"


@query("near_duplicate_probe", f"{PARTS}, s AS (SELECT u.id, e.id AS other, e.chunk, round(greatest(0, least(1, list_cosine_similarity(u.v, e.v))), 6) AS similarity FROM u JOIN e ON u.id <> e.id AND u.scope IS NOT DISTINCT FROM e.scope WHERE round(list_cosine_similarity(u.v, e.v), 6) >= 0.2) {BEST}")
def _(t):
    return pr.near_documents(*parts(t), threshold=0.2)


@query("near_duplicate_probe_l2", f"{PARTS}, s AS (SELECT * REPLACE (round(greatest(0, 1 - least(1, similarity / sqrt(2 * (1 - 0.2)))), 6) AS similarity) FROM (SELECT u.id, e.id AS other, e.chunk, list_distance(u.v, e.v) AS similarity FROM u JOIN e ON u.id <> e.id AND u.scope IS NOT DISTINCT FROM e.scope) WHERE similarity <= sqrt(2 * (1 - 0.2)) + 1e-9) {BEST}")
def _(t):
    return pr.near_documents(*parts(t), threshold=0.2, metric="l2")


@query("router_validation", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN lang ELSE ' ' END AS tenant, ([NULL, ' 3 ', '12', '0', 'x', '', '-1'])[1 + doc_id % 7] AS k, ([NULL, '2', '50', '900', '1.5', ' '])[1 + doc_id % 6] AS m, (['', 'ACTIVE', ' all', 'none', NULL])[1 + doc_id % 5] AS v, doc_id % 11 = 0 AS odd FROM documents),
 n AS (SELECT *, least(10, greatest(1, coalesce(try_cast(trim(k) AS int), 5))) AS ek, try_cast(CASE WHEN regexp_matches(trim(m), '^[0-9]+$') THEN trim(m) END AS int) AS em FROM r),
 e AS (SELECT *, CASE WHEN odd THEN 'ROUTER_COLLECTION_ID_INVALID' WHEN trim(tenant) = '' THEN 'ROUTER_TENANT_REQUIRED' WHEN trim(k) IN ('0', 'x', '-1') THEN 'ROUTER_TOP_K_INVALID' WHEN trim(m) = '1.5' THEN 'ROUTER_MAX_CANDIDATES_INVALID' WHEN em < ek THEN 'ROUTER_MAX_CANDIDATES_LT_TOP_K' WHEN v = 'none' THEN 'ROUTER_VISIBILITY_INVALID' END AS error FROM n)
 SELECT doc_id, error, CASE WHEN error IS NULL THEN ek END::int AS effective_top_k, CASE WHEN error IS NULL THEN CASE WHEN coalesce(trim(k), '') = '' THEN 'from_default' ELSE 'from_state' END END AS top_k_source, CASE WHEN error IS NULL THEN least(200, coalesce(em, 200)) END::int AS effective_max_candidates,
  CASE WHEN error IS NULL THEN CASE WHEN coalesce(trim(m), '') = '' THEN 'from_default' ELSE 'from_state' END END AS max_candidates_source FROM e""")
def _(t):
    i = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i % len(x) + 1).cast("int"))
    r = t.documents.select(i, F.when(i % 9 > 0, F.col("lang")).otherwise(" ").alias("tenant_id"), pick(None, " 3 ", "12", "0", "x", "", "-1").alias("top_k"), pick(None, "2", "50", "900", "1.5", " ").alias("max_candidates"), pick("", "ACTIVE", " all", "none", None).alias("visibility"), F.when(i % 11 == 0, "odd").otherwise("").alias("collection_id"))
    return sc.validated(r).select("doc_id", "error", "effective_top_k", "top_k_source", "effective_max_candidates", "max_candidates_source")
