"""Queries over coverage, recommendations, drift, evaluation cases and requests to delete."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import assessment as asm
from .registry import query
from .text import facet_sql


@query("prefix_coverage", """WITH c AS (SELECT doc_id AS n, source, CASE doc_id % 4 WHEN 0 THEN ' ' || lang || ' | ' || repeat('x', doc_id % 200) WHEN 1 THEN ' ' WHEN 2 THEN lang END AS p FROM documents), k AS (SELECT n, source, CASE WHEN trim(p) <> '' THEN trim(p) END AS p FROM c)
 SELECT source, count(*) AS chunk_count, count(p) AS with_prefix, count(*) - count(p) AS missing_prefix, round(count(p) / count(*), 6)::double AS coverage_ratio, round(coalesce(avg(length(p)), 0), 6)::double AS mean_prefix_length, coalesce(max(length(p)), 0)::int AS max_prefix_length, coalesce(list(left(p, 160) ORDER BY n) FILTER (WHERE p IS NOT NULL), [])[1:3] AS samples FROM k GROUP BY source""")
def _(t):
    i = F.col("doc_id")
    prefix = F.when(i % 4 == 0, F.concat(F.lit(" "), "lang", F.lit(" | "), F.repeat(F.lit("x"), (i % 200).cast("int")))).when(i % 4 == 1, " ").when(i % 4 == 2, F.col("lang"))
    return asm.prefix_summary(t.documents.select("source", i.alias("n"), prefix.alias("prefix")), "source")


#: Documents whose texts hold words of some facets; the five longest of a language are its query's items.
WORDS = ["compliance gdpr policy", "api protocol system", "workflow steps process", "audit log", "", "dashboard", "privacy access control api"]
TEXT = "text || ' ' || (" + "[" + ", ".join(f"'{w}'" for w in WORDS) + "])[1 + doc_id % 7]"
MELT = " UNION ALL ".join(f"SELECT lang, doc_id, '{n}' AS facet, {i} AS position, least(1.0, ({' + '.join(f'''contains(lower(x), '{w}')::int''' for w in ws)}) / 3.0) AS score FROM d" for i, (n, ws) in enumerate(tx.FACET_KEYWORDS.items()))
GAPS = f"""WITH d AS (SELECT lang, doc_id, n_chars, {TEXT} AS x FROM documents), m AS ({MELT}), a AS (SELECT lang, facet, avg(score) AS mean FROM m GROUP BY ALL),
 i AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM d QUALIFY rank <= 5), g AS (SELECT i.lang, i.doc_id, i.rank, m.facet, m.position FROM i JOIN m USING (doc_id) JOIN a ON a.lang = i.lang AND a.facet = m.facet WHERE score >= 0.2 AND mean < 0.4)"""


def texts(t):
    put = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.concat("text", F.lit(" "), put).alias("text"), "n_chars")


def items(t):
    d = texts(t)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id"))).where("rank <= 5"), asm.facet_means(d, "query_id")


@query("coverage_delta", GAPS + """, f AS (SELECT lang, facet, min({'r': rank, 'p': position}) AS place FROM g GROUP BY ALL)
 SELECT l.lang AS query_id, CASE WHEN s IS NULL THEN 'Hybrid ranking maintains existing coverage' ELSE 'Adds coverage across: ' || s END AS delta FROM (SELECT DISTINCT lang FROM i) l LEFT JOIN (SELECT lang, string_agg(facet, ', ' ORDER BY place) AS s FROM f GROUP BY lang) USING (lang)""")
def _(t):
    return asm.coverage_delta(*items(t))


@query("recommended_ingest", GAPS + """, s AS (SELECT lang, doc_id, string_agg(facet, ', ' ORDER BY position) AS tags FROM g GROUP BY ALL)
 SELECT i.lang AS query_id, i.doc_id AS id, i.rank::int AS rank, CASE WHEN tags IS NULL THEN 'High relevance candidate' ELSE 'Addresses gaps: ' || tags END AS reason FROM i LEFT JOIN s ON s.lang = i.lang AND s.doc_id = i.doc_id WHERE i.doc_id % 5 < 3 AND i.doc_id % 7 <> 2""")
def _(t):
    i = F.col("doc_id")
    host = F.when(i % 5 == 0, "https://a.gov/x").when(i % 5 < 3, "https://b.com/x").otherwise(F.lit(None))
    url = F.concat(host, F.when(i % 7 == 2, ".pdf").otherwise(""))
    known = t.documents.select(i.alias("id"), urls.host_traits(url)[1].alias("trust"), urls.is_pdf(url, F.lit(None).cast("string")).alias("is_pdf"))
    return asm.recommended(*items(t), known)


@query("grouped_matches", f"""WITH m AS (SELECT conv_id // 3 AS query_id, conv_id * 100 + turn AS n, CASE WHEN turn % 4 = 0 THEN role ELSE ' ' END AS document_id, CASE WHEN turn % 4 = 1 THEN 'i' || turn % 2 END AS id, CASE WHEN turn % 4 = 2 THEN role END AS source, CASE WHEN turn % 2 = 0 THEN 'title ' || turn END AS title, CASE WHEN turn % 5 = 3 THEN NULL ELSE text END AS text FROM conversations),
 k AS (SELECT *, coalesce(nullif(trim(document_id), ''), id, source, 'unknown') AS key FROM m), g AS (SELECT query_id, key, string_agg(coalesce(text, ''), chr(10) ORDER BY n) AS c, arg_min(coalesce(title, 'RAG Document'), n) AS title, arg_min({{'u': source}}, n).u AS url, count(*) AS matches FROM k GROUP BY ALL)
 SELECT query_id, key, title, url, matches, c AS combined, {facet_sql('c')} FROM g WHERE trim(c, ' \t\n\r') <> ''""")
def _(t):
    k, none = F.col("turn"), F.lit(None).cast("string")
    m = t.conversations.select(
        F.floor(F.col("conv_id") / 3).alias("query_id"), (F.col("conv_id") * 100 + k).alias("n"), F.when(k % 4 == 0, F.col("role")).otherwise(" ").alias("document_id"), F.when(k % 4 == 1, F.concat(F.lit("i"), k % 2)).alias("id"), none.alias("hash"),
        F.when(k % 4 == 2, F.col("role")).alias("source"), F.when(k % 2 == 0, F.concat(F.lit("title "), k)).alias("title"), none.alias("citation"), none.alias("source_url"), F.when(k % 5 != 3, F.col("text")).alias("text"),
    )
    return asm.match_summaries(m, pool=100_000).drop("key_points")


@query("eval_cases", """WITH e AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000), c AS (SELECT event_type AS query_text, CASE WHEN user_id % 2 = 0 THEN 'k' || user_id % 3 END AS case_id, CASE WHEN user_id % 5 = 0 THEN 'c' END AS collection_id, NULL::varchar AS workflow_id, 't' || user_id % 4 AS thread_id,
  CASE event_id % 4 WHEN 0 THEN 'ch' || event_id % 50 WHEN 1 THEN 's' || event_id % 20 WHEN 2 THEN 'l' || event_id % 10 END AS r FROM e WHERE event_type <> 'error')
 SELECT query_text, case_id, collection_id, workflow_id, thread_id, list_sort(list(DISTINCT r)) AS relevant_ids FROM c WHERE r IS NOT NULL GROUP BY ALL""")
def _(t):
    u, e = F.col("user_id"), F.col("event_id")
    ev = t.events.select(
        F.col("ts").alias("created_at"), "event_id", F.when(F.col("event_type") != "error", F.concat(F.lit(" "), "event_type")).otherwise(" ").alias("query_text"), F.when(e % 4 == 0, F.concat(F.lit("ch"), e % 50)).otherwise("").alias("chunk_id"), F.when(e % 4 == 1, F.concat(F.lit("s"), e % 20)).alias("source_id"),
        F.when(e % 4 == 2, F.concat(F.lit("l"), e % 10)).alias("source_label"), F.when(u % 2 == 0, F.concat(F.lit("k"), u % 3)).otherwise(" ").alias("case_id"), F.when(u % 5 == 0, "c").alias("collection_id"), F.lit("").alias("workflow_id"), F.concat(F.lit("t"), u % 4).alias("thread_id"),
    )
    return asm.eval_cases(ev)


@query("drift_overlap", """WITH e AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 10 > 0 THEN 't' || conv_id % 3 END AS tenant_id, CASE conv_id % 4 WHEN 0 THEN ['x' || conv_id, 'c' || conv_id % 7] ELSE [] END AS c, CASE WHEN conv_id % 4 < 3 THEN ['d' || conv_id % 5] END AS d FROM conversations WHERE turn = 0 AND trim(text) <> ''),
 f AS (SELECT conv_id AS query_id, 'c' || turn AS c, CASE WHEN turn % 2 = 0 THEN 'd' || turn % 5 END AS d FROM conversations), w AS (SELECT * FROM e WHERE tenant_id IS NOT NULL AND (len(c) > 0 OR len(d) > 0)),
 h AS (SELECT w.tenant_id, EXISTS (SELECT 1 FROM f WHERE f.query_id = w.query_id AND CASE WHEN len(w.c) > 0 THEN list_contains(w.c, f.c) ELSE coalesce(list_contains(w.d, f.d), false) END) AS hit FROM w),
 r AS (SELECT tenant_id, round(avg(hit::int), 6) AS recall, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM h GROUP BY tenant_id) SELECT *, CASE tenant_id WHEN 't0' THEN round(recall - 0.9, 6) WHEN 't1' THEN round(recall - 0.1, 6) END AS delta, coalesce(CASE tenant_id WHEN 't0' THEN round(recall - 0.9, 6) WHEN 't1' THEN round(recall - 0.1, 6) END <= -0.1, false) AS alert FROM r""")
def _(t):
    i, k = F.col("conv_id"), F.col("turn")
    want = t.conversations.where("turn = 0").select(
        i.alias("query_id"), F.when(i % 10 > 0, F.concat(F.lit("t"), i % 3)).otherwise(" ").alias("tenant_id"), F.col("text").alias("query"), F.when(i % 4 == 0, F.array(F.concat(F.lit("x"), i), F.concat(F.lit("c"), i % 7), F.lit(None))).alias("chunk_ids"), F.when(i % 4 < 3, F.array(F.concat(F.lit("d"), i % 5))).alias("document_ids"),
    )
    found = t.conversations.select(i.alias("query_id"), F.concat(F.lit("c"), k).alias("chunk_id"), F.when(k % 2 == 0, F.concat(F.lit("d"), k % 5)).alias("document_id"))
    before = t.spark.createDataFrame([("t0", 0.9), ("t1", 0.1)], "tenant_id string, recall double")
    return asm.drift_recall(want, found, before)


@query("label_sequence", """WITH v AS (SELECT l_orderkey AS document, l_returnflag AS label, l_linenumber AS sequence, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) * 2 AS label_sequence FROM lineitem), i AS (SELECT o_orderkey + 1 AS document, CASE WHEN o_orderkey % 3 > 0 THEN 'A' END AS label FROM orders)
 SELECT i.document, i.label, coalesce((SELECT max(sequence) FROM v WHERE v.document = i.document), 0) + 1 AS sequence, coalesce((SELECT max(label_sequence) FROM v WHERE v.document = i.document AND v.label = i.label), 0) + 1 AS label_sequence FROM i""")
def _(t):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")).cast("long") * 2
    v = t.lineitem.select(F.col("l_orderkey").alias("document"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("sequence"), n.alias("label_sequence"))
    return asm.next_sequences(v, t.orders.select((F.col("o_orderkey") + 1).alias("document"), F.when(F.col("o_orderkey") % 3 > 0, "A").alias("label")))


@query("history_append", """WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 7 <> 3 THEN role END AS role, text AS content FROM conversations UNION ALL SELECT conv_id, 1000, 'user', CASE WHEN conv_id % 3 > 0 THEN 'new' ELSE '' END FROM conversations WHERE turn = 0)
 SELECT conv_id, turn, role, content FROM h WHERE role IS NOT NULL AND (turn < 1000 OR content <> '') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 6""")
def _(t):
    k = F.col("turn")
    old = t.conversations.select("conv_id", "turn", F.when(k % 7 != 3, F.col("role")).alias("role"), F.col("text").alias("content"))
    new = t.conversations.where("turn = 0").select("conv_id", F.lit(1000).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("conv_id") % 3 > 0, "new").otherwise("").alias("content"))
    return asm.appended_history(old, new)


UUID = "'00000000-0000-4000-8000-' || lpad(printf('%x', {0}), 12, '0')"


@query("delete_requests", f"""WITH r AS (SELECT o_orderkey AS request_id, o_orderkey % 3 AS tenant, o_orderkey % 11 = 0 AS no_reason, o_orderkey % 13 = 0 AS no_ticket, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS user_id, o_orderkey % 7 = 0 AS key, o_orderkey % 4 = 0 AS label, [o_orderkey, o_orderkey + 1, o_orderkey + 40, o_orderkey] AS ids FROM orders),
 u AS (SELECT r.*, c_custkey IS NOT NULL AS known, c_acctbal > 0 AS active, c_nationkey = 3 AS adm, c_custkey % 6 = 0 AS org, c_name FROM r LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 9 > 0),
 s AS (SELECT *, CASE WHEN no_reason THEN 'reason' WHEN no_ticket THEN 'ticket_ref' WHEN key THEN 'deleted' WHEN user_id IS NULL THEN 'actor' WHEN NOT known THEN 'unknown_user' WHEN NOT active THEN 'inactive' WHEN adm OR org THEN 'deleted' ELSE 'no_admin' END AS status FROM u),
 d AS (SELECT o_orderkey AS k, o_orderkey % 3 AS tenant FROM orders WHERE o_orderstatus <> 'P')
 SELECT request_id, status, CASE WHEN status = 'deleted' THEN CASE WHEN label THEN 'lab' WHEN key THEN 'k1' ELSE c_name END END AS operator, CASE WHEN status = 'deleted' THEN CASE WHEN key THEN 'service_key' WHEN adm THEN 'user_admin' ELSE 'org_admin' END END AS mode,
  CASE WHEN status = 'deleted' THEN coalesce(list_sort(f), []) ELSE [] END AS deleted_ids, CASE WHEN status = 'deleted' THEN 3 - len(coalesce(f, [])) END::int AS not_found
 FROM s LEFT JOIN (SELECT request_id AS q, list({UUID.format('k')}) AS f FROM (SELECT request_id, s.tenant, unnest(list_distinct(ids)) AS k FROM s) x JOIN d USING (k, tenant) GROUP BY request_id) ON q = request_id""")
def _(t):
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    u = lambda x: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(x)), 12, "0"))
    tenant = F.concat(F.lit("t"), o % 3)
    r = t.orders.select(
        o.alias("request_id"), tenant.alias("tenant_id"), F.when(o % 11 > 0, "why").otherwise(" ").alias("reason"), F.when(o % 13 > 0, "T-1").alias("ticket_ref"), F.when(o % 5 > 0, F.col("o_custkey")).alias("user_id"), F.when(o % 7 == 0, "k1").otherwise("k9").alias("internal_key"),
        F.when(o % 4 == 0, "lab").alias("label"), F.array(u(o), F.upper(u(o + 1)), u(o + 40), u(o), F.lit("none")).alias("document_ids"),
    )
    users = t.customer.where("c_custkey % 9 > 0").select(c.alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_nationkey") == 3, "TENANT_ADMIN").otherwise("LEGAL").alias("role"))
    docs = t.orders.where("o_orderstatus <> 'P'").select(u(o).alias("document_id"), tenant.alias("tenant_id"))
    return asm.delete_requests(r, users, t.customer.where("c_custkey % 6 = 0").select(c.alias("user_id")), docs, ["k1"])


@query("contract_errors", """SELECT doc_id, list_filter([CASE WHEN doc_id % 10 = 0 THEN 'tenant_empty' END, CASE WHEN doc_id % 10 = 1 THEN 'tenant_too_long' END, CASE WHEN doc_id % 6 = 1 THEN 'workflow_too_long' WHEN doc_id % 6 = 2 THEN 'workflow_invalid_char' END, CASE WHEN length(trim(text)) > 256 THEN 'title_too_long' END,
 CASE WHEN doc_id % 4 = 1 THEN 'tag_too_long' END, CASE WHEN doc_id % 4 = 2 THEN 'tag_invalid' END, CASE WHEN doc_id % 5 IN (1, 2) THEN 'language_invalid' END, CASE WHEN doc_id % 7 = 0 THEN 'media_type_empty' WHEN doc_id % 7 = 1 THEN 'media_type_invalid' END, CASE WHEN doc_id % 8 IN (1, 2, 3, 4) THEN 'bbox_invalid' END], lambda x: x IS NOT NULL) AS errors FROM documents""")
def _(t):
    i = F.col("doc_id")
    box = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    errors = asm.contract_errors(
        F.when(i % 10 == 0, " ").when(i % 10 == 1, F.repeat(F.lit("t"), 129)).otherwise("t"), F.when(i % 6 == 1, F.repeat(F.lit("w"), 129)).when(i % 6 == 2, "a b").when(i % 6 == 3, " ").otherwise("w-1.x"), F.col("text"),
        F.when(i % 4 == 1, F.array(F.lit("ok"), F.repeat(F.lit("x"), 65))).when(i % 4 == 2, F.array(F.lit("a/b"), F.lit(" "))).when(i % 4 == 3, F.array(F.lit(" a "), F.lit(""))), F.when(i % 5 == 0, "en-US").when(i % 5 == 1, "en--US").when(i % 5 == 2, "123"),
        F.when(i % 7 == 0, "").when(i % 7 == 1, "text").otherwise("Text/HTML ; charset=x"), F.when(i % 8 == 0, box(0, 0, 1, 1)).when(i % 8 == 1, box(0, 0, 1)).when(i % 8 == 2, box(0, 0, 0, 1)).when(i % 8 == 3, box(0, 0, 1, 1.5)).when(i % 8 == 4, box(0, 0, None, 1)),
    )
    return t.documents.select("doc_id", errors.alias("errors"))


@query("media_counters", """WITH b AS (SELECT page_id, len(regexp_extract_all(lower(html), '<p[ >]')) AS n FROM pages), a AS (SELECT page_id, unnest(range(page_id % 4)) AS i FROM pages), k AS (SELECT page_id, (['image_png', 'text_html', NULL])[1 + (page_id + i) % 3] AS t FROM a),
 c AS (SELECT page_id, t, count(*) AS n FROM k WHERE t IS NOT NULL GROUP BY ALL) SELECT page_id AS document, n AS blocks, page_id % 4 AS assets, (SELECT coalesce(string_agg('parse.assets.media_type.' || t || '=' || c.n, ',' ORDER BY t), '') FROM c WHERE c.page_id = b.page_id) AS media FROM b""")
def _(t):
    i = F.col("page_id")
    p = t.pages.select(i.alias("document"), "html")
    blocks = p.select("document", F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<p[ >]"), F.lit(0)))).select("document")
    kind = F.element_at(F.array(F.lit("image/png"), F.lit("text/html"), F.lit(None)), ((F.col("document") + F.col("k")) % 3 + 1).cast("int"))
    assets = p.where("document % 4 > 0").select("document", F.explode(F.sequence(F.lit(0).cast("long"), F.col("document") % 4 - 1)).alias("k")).select("document", kind.alias("media_type"))
    s = asm.parse_statistics(p, blocks, assets)
    media = F.array_join(F.transform(F.array_sort(F.filter(F.map_entries("statistics"), lambda e: e["key"].startswith("parse.assets.media_type"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.select("document", F.col("statistics")["parse.blocks.total"].alias("blocks"), F.col("statistics")["parse.assets.total"].alias("assets"), media.alias("media"))
