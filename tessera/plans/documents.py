"""Queries over parsing, chunking, duplicates and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stages import shared_folder
from ..operators import chunking as ch
from ..operators import dedup as dd
from ..operators import upserts as up
from ..sources import files, html
from ..streaming import jobs
from .registry import query



@query("html_blocks")
def _(t):
    b = html.parse(t.pages)
    return b.select("page_id", "block", "kind", F.md5("text").alias("text_md5"), F.array_join("section_path", " / ").alias("path"))


@query("html_statistics")
def _(t):
    b = html.parse(t.pages)
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    return b.groupBy("page_id", "kind").agg(F.count("*").alias("blocks"), F.sum(words).alias("words"))


TAGS = ["p", "h1", "h2", "ul", "table", "img", "script"]


@query("html_counts", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(lower(html), '<{x}[ >]'))::int AS n_{x}" for x in TAGS) + " FROM pages")
def _(t):
    return t.pages.select("page_id", *html.tag_counts(F.col("html"), TAGS))


@query("html_language", r"""SELECT page_id, lower(nullif(regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1), '')) AS lang FROM pages""")
def _(t):
    return t.pages.select("page_id", html.language(F.col("html")).alias("lang"))


@query("markdown_blocks")
def _(t):
    f = t.documents.select(F.col("doc_id").alias("id"), F.lit("text/markdown").alias("media_type"), F.encode(F.concat(F.lit("# Title\n\n"), F.col("text")), "UTF-8").alias("content"))
    return files.parse(f).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("parser_dispatch", "SELECT doc_id, (['text/markdown', 'text/html', 'text/plain', 'image/*', NULL])[doc_id % 5 + 1] AS reader FROM documents")
def _(t):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", files.reader_name(pick("", "text/html", "text/plain", "image/png", "video/mp4"), pick("a.MD", "b", "c", "d", "e")).alias("reader"))


@query("payload_decode", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(files.decode_payload(F.encode(F.base64(F.encode(F.col("text"), "UTF-8")), "UTF-8"), F.lit("base64"))).alias("text_md5"))


@query("object_sink", "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'new' ELSE md5(text) END AS text_md5, source FROM documents")
def _(t):
    path, d = scratch(t, "objects"), t.documents.select("doc_id", "lang", F.encode(F.md5("text"), "UTF-8").alias("payload"), "source")
    files.store_objects(d, path, "lang")
    files.store_objects(d.where("lang = 'en'").withColumn("payload", F.encode(F.lit("new"), "UTF-8")), path, "lang")
    held = files.stored_objects(t.spark, path, "doc_id long, lang string, payload binary, source string")
    return held.select("doc_id", "lang", F.decode("payload", "UTF-8").alias("text_md5"), "source")


@query("payload_charsets", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'utf-16be' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'iso-8859-1' WHEN 3 THEN '' WHEN 4 THEN 'utf-8' ELSE '' END AS charset, md5(CASE WHEN doc_id % 6 = 2 THEN 'é' || doc_id WHEN doc_id % 6 = 5 THEN 'ü' || doc_id ELSE text END) AS text_md5 FROM documents")
def _(t):
    i, text = F.col("doc_id"), F.col("text")
    content = (
        F.when(i % 6 == 0, F.encode(text, "UTF-16BE")).when(i % 6 == 1, F.encode(text, "UTF-16")).when(i % 6 == 2, F.encode(F.concat(F.lit("é"), i), "ISO-8859-1")).when(i % 6 == 3, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(i % 6 == 4, F.encode(text, "UTF-8")).otherwise(F.encode(F.concat(F.lit("ü"), i), "ISO-8859-1"))
    )
    kind = F.when(i % 6 == 0, "text/plain; charset=UTF-16BE").when(i % 6 == 1, 'text/html;charset="utf-16"').when(i % 6 == 2, "text/plain; a=b; Charset = ISO-8859-1 ; c=d").when(i % 6 == 3, "text/plain").when(i % 6 == 4, "text/plain; charset=utf-8")
    return t.documents.select("doc_id", files.declared_charset(kind).alias("charset"), F.md5(files.declared_text(content, kind)).alias("text_md5"))


@query("chunks_plain")
def _(t):
    return ch.chunked(t.documents).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("n_sentences").alias("sentences"))


@query("chunks_late")
def _(t):
    return ch.chunked(t.documents, "late", 450, 80).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("n_sentences").alias("sentences"))


@query("chunks_windows")
def _(t):
    d = t.documents.select("doc_id", "text", F.lit("late").alias("mode"), F.lit(None).cast("array<int>").alias("ends"))
    return ch.hybrid(d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("n_sentences").alias("sentences"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n")).alias("texts_md5"))


@query("chunks_hybrid")
def _(t):
    d, key = t.documents, F.col("doc_id")
    d = d.select("doc_id", "text", F.when(key % 3 == 0, "agentic").when(key % 3 == 1, "late").alias("mode"), F.when(key % 2 == 0, F.array(F.lit(1))).alias("ends"))
    return ch.hybrid(d).groupBy("mode", "fell_back").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max("n_sentences").alias("longest"))


@query("chunks_sections")
def _(t):
    text = F.concat(F.lit("# "), "lang", F.lit("\nIntro of it.\n## "), "source", F.lit("\n"), "text", F.lit("\n# End\nThe end."))
    return ch.by_section(t.documents.select("doc_id", text.alias("text"))).groupBy("doc_id", F.array_join("path", " / ").alias("path")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


DANGLES = " OR ".join(f"starts_with(lower(text), '{p}') OR contains(left(lower(text), 50), ' {p}')" for p in ch.DANGLING)
PROBLEMS = f"""SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 50 THEN 'too_short' END, CASE WHEN length(text) > 2000 THEN 'too_long' END,
  CASE WHEN {DANGLES} THEN 'dangling_reference' END, CASE WHEN trim(text) <> '' AND NOT contains('.!?:"' || chr(39), right(trim(text), 1)) THEN 'incomplete_sentence' END,
  CASE WHEN length(text) - length(replace(text, '|', '')) > 5 THEN 'table_fragment' END], lambda x: x IS NOT NULL) AS problems FROM conversations"""


@query("chunk_problems", PROBLEMS)
def _(t):
    return t.conversations.select("conv_id", "turn", ch.problems(F.col("text")).alias("problems"))


ISSUES = r"""SELECT conv_id, turn, issues, (100 - 25 * len(issues))::int AS score FROM (SELECT conv_id, turn, list_filter([CASE WHEN e <> '' AND NOT contains('.!?:;', right(e, 1)) THEN 'ends_mid_sentence' END,
  CASE WHEN lower(left(n, 1)) = left(n, 1) AND upper(left(n, 1)) <> left(n, 1) THEN 'starts_lowercase' END, CASE WHEN regexp_matches(n, '^(dieser|diese|dieses|das |dies )') THEN 'dangling_reference' END,
  CASE WHEN regexp_matches(e, '(1\.|2\.|3\.|a\)|b\))$') THEN 'list_header_orphan' END], lambda x: x IS NOT NULL) AS issues
  FROM (SELECT conv_id, turn, trim(text) AS e, trim(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS n FROM conversations) WHERE n IS NOT NULL)"""


@query("boundary_issues", ISSUES)
def _(t):
    return ch.boundary_issues(t.conversations, "conv_id", "turn")


@query("overlap_ratio", r"SELECT doc_id, round(CASE WHEN trim(text) = '' OR lang = 'es' THEN 0.1 ELSE greatest(0.1, least(0.25, CASE WHEN lang = 'fr' THEN 0.22 ELSE 0.15 END + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) > 4 THEN 0.02 ELSE 0 END)) END, 6)::double AS ratio FROM documents")
def _(t):
    kind = F.when(F.col("lang") == "es", "faq").when(F.col("lang") == "fr", "article").otherwise("note")
    return t.documents.select("doc_id", F.round(ch.overlap_ratio(F.col("text"), kind), 6).alias("ratio"))


@query("context_header", "SELECT doc_id, left(array_to_string(list_slice(string_split(source || ' - ' || lang, ' '), 1, 14), ' '), 140) || chr(10) || chr(10) || left(text, 20) AS headed FROM documents")
def _(t):
    return t.documents.select("doc_id", ch.with_header(F.substring("text", 1, 20), ch.header(F.col("source"), F.col("lang"))).alias("headed"))


@query("parent_lineage", "WITH f AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM conversations GROUP BY conv_id, role) SELECT conv_id::varchar AS document, turn AS ord, count(*) OVER (PARTITION BY conv_id) AS chunk_count, [conv_id || '#doc', conv_id || '#s' || n] AS parent_ids FROM conversations JOIN f USING (conv_id, role)")
def _(t):
    return ch.lineage(t.conversations.select(F.col("conv_id").cast("string").alias("document"), F.col("turn").alias("ord"), F.col("role").alias("section")))


@query("exact_dup_groups", r"SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return dd.exact_groups(t.documents)


PAIRS = r"""WITH s AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+'))) AS s, min(doc_id) AS id FROM documents GROUP BY 1), w AS (SELECT id, len(s) AS n, unnest(s) AS w FROM s WHERE len(s) > 0),
 c AS (SELECT a.id AS a, b.id AS b, a.n, b.n AS m, count(*) AS k FROM w a JOIN w b USING (w) WHERE a.id < b.id AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 GROUP BY ALL) SELECT a, b, round(k / (n + m - k), 6)::double AS similarity FROM c WHERE k / (n + m - k) >= 0.8"""


@query("near_dup_pairs", PAIRS)
def _(t):
    return dd.jaccard_pairs(t.documents.select(F.col("doc_id").alias("id"), "text"), 0.8)


@query("near_dup_members", r"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY s) AS representative FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+'))) AS s FROM documents) WHERE len(s) > 0")
def _(t):
    return dd.jaccard_members(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("embedding_near_dup", "SELECT id, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE r = 1 AND similarity >= 0.3")
def _(t):
    return dd.embedding_near(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v")), 0.3)


def stream(t):
    e = t.events
    return jobs.read_events(t.spark, f"{t.sf_dir}/events.parquet*", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_rate_limits", "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS n, least(count(*), 2) AS allowed FROM events GROUP BY ALL")
def _(t):
    got = jobs.run_available(jobs.rate_limits(stream(t), 2), scratch(t, "rates"), "complete")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return jobs.run_available(jobs.once(stream(t), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), scratch(t, "once"))


@query("stream_feedback")
def _(t):
    got = jobs.run_available(jobs.feedback_weights(stream(t)), scratch(t, "weights"), "complete")
    return got.select(F.col("at").cast("string").alias("at"), "event_type", F.round("weight", 4).alias("weight"))


@query("stream_dead_letters", "SELECT event_id FROM events WHERE NOT (value < 50)")
def _(t):
    return jobs.run_available(jobs.split_bad(stream(t), F.col("value") < 50)[1].select("event_id"), scratch(t, "dead"))


@query("stream_changes")
def _(t):
    s = stream(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.md5("event_type").alias("hash"))
    return jobs.run_available(jobs.changes(s), scratch(t, "changes"))


@query("stream_breaker")
def _(t):
    s = stream(t).select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return jobs.run_available(jobs.breaker(s), scratch(t, "breaker"), "update")


def scratch(t, kind):
    """A folder in the place that driver and executors share."""
    return f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("eval_set_source", "SELECT item_id::varchar AS query_id, text AS question FROM benchmark")
def _(t):
    path = scratch(t, "eval")
    t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question")).write.json(path)
    return files.eval_set(t.spark, path).select("query_id", "question")


@query("versioned_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def _(t):
    path, d = scratch(t, "upsert"), t.documents.select("doc_id", "lang")
    files.upsert(t.spark, path, d, "doc_id")
    files.upsert(t.spark, path, d.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id")
    return files.current(t.spark, path, "doc_id")


@query("committed_upsert", """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS newer, doc_id % 3 = 2 AND doc_id % 5 = 0 AS whole FROM documents)
 SELECT doc_id * 10 + 1 AS chunk_id, doc_id AS key, 'v1' AS version, NOT newer AS is_latest, true AS has_vector FROM d WHERE NOT whole UNION ALL SELECT doc_id * 10 + 2, doc_id, 'v2', true, doc_id % 2 = 0 FROM d WHERE newer UNION ALL SELECT doc_id * 10 + 3, doc_id, NULL, true, doc_id % 2 = 0 FROM d WHERE whole""")
def _(t):
    tables, i = up.store(t.spark, scratch(t, "commits")), F.col("doc_id")
    said = lambda rows, add: rows.select(i.alias("key"), F.md5(F.concat("text", F.lit(add))).alias("hash"))
    parts = lambda rows, n, v: rows.select((i * 10 + n).alias("chunk_id"), i.alias("key"), F.lit(v).cast("string").alias("version"), F.lit(True).alias("is_latest"))
    first, newer, whole = t.documents, t.documents.where("doc_id % 3 = 0"), t.documents.where("doc_id % 3 = 2 AND doc_id % 5 = 0")
    one = parts(first, 1, "v1")
    up.upsert(tables, said(first, ""), one, one.select("chunk_id", F.array(F.lit(1.0)).alias("v")))
    same = t.documents.where("doc_id % 3 = 1 AND doc_id % 2 = 0")  # unchanged: nothing of them is written
    two = parts(newer, 2, "v2").unionByName(parts(whole, 3, None)).unionByName(parts(same, 4, "v3"))
    up.upsert(tables, said(newer, "+").unionByName(said(whole, "+")).unionByName(said(same, "")), two, two.where("key % 2 = 0").select("chunk_id", F.array(F.lit(2.0)).alias("v")))
    held = tables.table("embeddings").select("chunk_id", F.lit(True).alias("has_vector"))
    return tables.table("chunks").join(held, "chunk_id", "left").fillna(False, ["has_vector"])
