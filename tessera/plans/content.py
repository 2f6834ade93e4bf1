"""Queries over captions, mentions, rankings, settings and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls, vectors
from ..operators import content as co
from .registry import query
from .scalars import HOST


@query("captions", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 2 = 0 THEN lang END AS caption, CASE WHEN doc_id % 3 = 0 THEN 'alt_text' WHEN doc_id % 2 = 0 THEN 'direct' ELSE 'none' END AS origin, CASE WHEN doc_id % 3 = 0 THEN 0.9 WHEN doc_id % 2 = 0 THEN 0.6 ELSE 0.0 END::double AS confidence FROM documents")
def _(t):
    i = F.col("doc_id")
    candidates = F.array(F.struct(F.lit("notes").alias("source"), F.lit(" ").alias("text")), F.struct(F.lit("alt_text").alias("source"), F.when(i % 3 == 0, F.col("source")).alias("text")))
    c = co.caption(candidates, F.when(i % 2 == 0, F.col("lang")))
    return t.documents.select("doc_id", c["text"].alias("caption"), c["source"].alias("origin"), c["confidence"].alias("confidence"))


@query("caption_gates", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'keep' WHEN doc_id % 2 = 1 THEN 'skip' WHEN n_chars >= 1000 THEN 'caption' WHEN lang = 'fr' THEN 'ocr' ELSE 'none' END AS gate FROM documents")
def _(t):
    i = F.col("doc_id")
    g = co.caption_gate(F.when(i % 7 == 0, F.col("text")), F.when(i % 2 == 0, "image/png").otherwise("text/plain"), F.col("n_chars"), 1000, F.when(F.col("lang") == "fr", F.col("lang")))
    return t.documents.select("doc_id", g.alias("gate"))


@query("mentions", "SELECT o_orderkey AS comment_id, c_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    comments = t.orders.select(F.col("o_orderkey").alias("comment_id"), F.concat(F.lit("Hi @Cust"), "o_custkey", F.lit(" and @nobody, @cust"), "o_custkey").alias("text"))
    return co.mentions(comments, t.customer.select(F.concat(F.lit("CUST"), "c_custkey").alias("name"), F.col("c_custkey").alias("user_id")))


@query("reference_expansion", "WITH m AS (SELECT conv_id AS query_id, conv_id * 1000 + turn AS id, turn AS rank, (conv_id + turn) % 100 AS document FROM conversations WHERE conv_id % 20 = 0), f AS (SELECT query_id, document FROM (SELECT query_id, document, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document) AS n FROM m GROUP BY query_id, document) WHERE n <= 5), c AS (SELECT conv_id * 1000 + turn AS id, conv_id AS document, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT query_id, id FROM m UNION SELECT f.query_id, c.id FROM f JOIN c USING (document) WHERE n <= 3")
def _(t):
    i = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    m = t.conversations.where("conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), i, F.col("turn").alias("rank"), F.array((F.col("conv_id") + F.col("turn")) % 100).alias("refs"))
    return co.reference_expansion(m, t.conversations.select(i, F.col("conv_id").alias("document"), F.col("turn").alias("ord")))


@query("model_ranking", "SELECT conv_id AS query_id, turn::varchar AS id, least(100.0, greatest(0.0, length(text) - 50.0))::double AS score, row_number() OVER (PARTITION BY conv_id ORDER BY least(100.0, greatest(0.0, length(text) - 50.0)) DESC, turn)::int AS rank FROM conversations WHERE turn % 3 <> 2")
def _(t):
    c = t.conversations
    answers = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("candidate_id"), (F.length("text") - 50.0).alias("score")))).alias("x"))
    twice = F.transform(F.concat("x", "x"), lambda s: F.struct(s["candidate_id"].alias("candidate_id"), s["score"].alias("score")))
    allowed = c.where("turn % 3 <> 2").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("id"))
    return co.model_ranking(answers.select("query_id", F.to_json(twice).alias("json")), allowed)


@query("web_selection", f"SELECT query_id, id, rank, rank = min(CASE WHEN pdf THEN rank ELSE rank + 1000 END) OVER (PARTITION BY query_id) % 1000 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id)::int AS rank FROM (SELECT page_id % 10 AS query_id, page_id AS id, page_id % 4 = 0 AS pdf, {HOST} AS h FROM pages) WHERE h <> 'example.org' AND h NOT LIKE '%.example.org') WHERE rank <= 5")
def _(t):
    p = t.pages.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("id"), F.col("page_id").alias("position"), "url", urls.host(F.col("url")).alias("host"), F.substring("html", 1, 200).alias("snippet"), F.lit(False).alias("preselected"), (F.col("page_id") % 4 == 0).alias("is_pdf"))
    return co.web_selection(p, ["example.org"])


@query("crawl_settings", f"SELECT page_id AS id, CASE WHEN h LIKE 'm.%' THEN 10 WHEN page_id % 2 = 0 THEN 20 ELSE 30 END AS delay FROM (SELECT page_id, {HOST} AS h FROM pages)")
def _(t):
    items = t.pages.select(F.col("page_id").alias("id"), urls.host(F.col("url")).alias("host"), F.when(F.col("page_id") % 2 == 0, "even").alias("provider"))
    hosts = items.where(F.col("host").startswith("m.")).select("host", F.lit(10).alias("delay")).distinct()
    providers = t.spark.createDataFrame([("even", 20)], "provider string, delay int")
    return co.resolved_settings(items, hosts, providers, ["delay"], {"delay": 30})


@query("cost_totals", "SELECT user_id, round(sum(greatest(0.0, value - 20) + 1.5), 6)::double AS cost FROM events GROUP BY user_id")
def _(t):
    e = t.events.select("user_id", (F.col("value") - 20).alias("a"), F.lit("1.5").alias("b"), F.col("event_type").alias("c"))
    return co.costs(e, "user_id", ["a", "b", "c"])


@query("same_content", "SELECT doc_id, doc_id % 2 = 0 AS same FROM documents")
def _(t):
    a = F.create_map(F.lit("content_hash"), F.md5("text"))
    b = F.create_map(F.lit("hash"), F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise("x"))
    return t.documents.select("doc_id", co.same_content(a, b).alias("same"))


@query("document_radius", "WITH p AS (SELECT source AS query_id, doc_id AS id, lang AS doc, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place FROM documents) SELECT a.query_id, a.id, b.id AS near FROM p a JOIN p b ON a.query_id = b.query_id AND a.doc = b.doc AND abs(a.place - b.place) BETWEEN 1 AND 2")
def _(t):
    return co.document_radius(t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("lang").alias("doc"), F.col("doc_id").alias("rank")), 2)


@query("retrieval_meta", "SELECT user_id, count(*) AS searches, round(sum(value), 4) AS took, max(event_id) AS last_id FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("searches"), F.round(F.sum("value"), 4).alias("took"), F.max("event_id").alias("last_id"))


@query("embedding_text_hash", r"""SELECT item_id, sha256(array_to_string(list_transform(string_split(trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')), ' '), lambda w:
      CASE WHEN length(w) <= 4 OR NOT regexp_full_match(w, '[\p{L}\p{N}_]+') THEN w
           WHEN w LIKE '%en' AND length(w) >= 6 THEN left(w, length(w) - 2)
           WHEN w LIKE '%n' OR w LIKE '%e' THEN left(w, length(w) - 1) ELSE w END), ' ')) AS text_hash FROM benchmark""")
def _(t):
    return t.benchmark.select("item_id", F.sha2(tx.normalise(F.col("text")), 256).alias("text_hash"))


@query("vector_parse", "SELECT vec_id, round(embedding[3]::double, 6) AS third, len(embedding) AS n FROM embeddings")
def _(t):
    v = vectors.parse(vectors.literal(F.col("embedding")))
    return t.embeddings.select("vec_id", F.round(v[2], 6).alias("third"), F.size(v).cast("long").alias("n"))


@query("superseded", "SELECT l_orderkey, l_linenumber, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_latest FROM lineitem")
def _(t):
    from pyspark.sql import Window

    newest = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == newest).alias("is_latest"))


@query("url_duplicate_of", f"SELECT page_id, nullif(min(page_id) OVER (PARTITION BY {HOST}), page_id) AS duplicate_of FROM pages")
def _(t):
    from pyspark.sql import Window

    first = F.min("page_id").over(Window.partitionBy(urls.host(F.col("url"))))
    return t.pages.select("page_id", F.nullif(first, F.col("page_id")).alias("duplicate_of"))
