"""Queries over joins, aggregates, windows and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import relational as rel
from .registry import query



@query("vector_scan", "SELECT e.vec_id AS chunk_id, d.doc_id AS document_id, d.source, e.label FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en'")
def _(t):
    e = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label")
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"))
    d = t.documents.select(F.col("doc_id").alias("document_id"), "source", "lang")
    return rel.scoped_chunks(e, c, d, F.col("lang") == "en").select("chunk_id", "document_id", "source", "label")


@query("chunks_by_document", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7 AND (role = 'user' OR turn < 3)")
def _(t):
    return t.conversations.where((F.col("conv_id") == 7) & ((F.col("role") == "user") | (F.col("turn") < 3))).select("conv_id", "turn", "role").orderBy("turn")


@query("neighbour_chunks", "SELECT a.conv_id * 1000 + a.turn AS target, b.conv_id AS document, b.turn AS ord, b.conv_id * 1000 + b.turn AS id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND a.turn <> b.turn AND a.role IS NOT DISTINCT FROM b.role")
def _(t):
    c = t.conversations.select(F.col("conv_id").alias("document"), F.col("turn").alias("ord"), F.col("role").alias("section"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return rel.neighbours(c, c, 2)


@query("version_diff", "SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0) b USING (doc_id)")
def _(t):
    d, i = t.documents, F.col("doc_id")
    left = d.where(i % 5 != 0).select(i.alias("id"), F.md5("text").alias("hash"))
    right = d.where(i % 7 != 0).select(i.alias("id"), F.when(i % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    return rel.version_diff(left, right)


@query("existing_document", "WITH s AS (SELECT doc_id AS id, 'x' || doc_id AS e, md5(text) AS h FROM documents WHERE doc_id < 500), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'x' || (doc_id - 300) END AS e, md5(text) AS h FROM documents WHERE doc_id >= 300), b AS (SELECT h, min(id) AS hid, arg_min(e, id) AS he FROM s GROUP BY h) SELECT n.id, coalesce(x.id, CASE WHEN NOT (b.he IS NOT NULL AND n.e IS NOT NULL AND b.he <> n.e) THEN b.hid END) AS found, x.id IS NULL AND (b.he IS NOT NULL AND n.e IS NOT NULL AND b.he <> n.e) AS vetoed FROM n LEFT JOIN s x ON x.e = n.e LEFT JOIN b ON b.h = n.h")
def _(t):
    d, i = t.documents, F.col("doc_id")
    base = d.select(i.alias("id"), F.md5("text").alias("hash"), F.lit("s").alias("source"))
    stored = base.where("id < 500").withColumn("external_id", F.concat(F.lit("x"), "id"))
    new = base.where("id >= 300").withColumn("external_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id") - 300)))
    return rel.existing_document(new, stored)


@query("partition_ids", "SELECT DISTINCT item_id AS doc_id, item_id IN (SELECT doc_id FROM labels) AS found FROM benchmark")
def _(t):
    return rel.partition_ids(t.benchmark.select(F.col("item_id").alias("doc_id")), t.labels, "doc_id")


@query("pending_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def _(t):
    cached = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return rel.pending(t.documents.select("doc_id"), cached, "doc_id", F.col("label") < 5)


@query("embedding_cache_read", "SELECT doc_id, vec_id IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT vec_id FROM embeddings WHERE label < 5) ON vec_id = doc_id")
def _(t):
    e = t.embeddings.where("label < 5").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("hit"))
    return t.documents.select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("chunk_counts", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))


@query("chunk_stats", "SELECT role, count(*) AS n, sum(length(text))::bigint AS total, min(length(text))::int AS shortest, max(length(text))::int AS longest, round(avg(length(text)), 6) AS mean, round(median(length(text)), 6) AS median, round(stddev_samp(length(text)), 6) AS deviation, count(*) FILTER (WHERE length(text) < 100) AS below_100, count(*) FILTER (WHERE length(text) >= 100 AND length(text) < 300) AS below_300, count(*) FILTER (WHERE length(text) >= 300 AND length(text) < 800) AS below_800, count(*) FILTER (WHERE length(text) >= 800 AND length(text) < 1500) AS below_1500, count(*) FILTER (WHERE length(text) >= 1500) AS from_1500 FROM conversations GROUP BY role")
def _(t):
    return rel.length_stats(t.conversations, ["role"], F.length("text"))


@query("chunk_length_by_document", "SELECT conv_id, min(length(text))::int AS shortest, max(length(text))::int AS longest, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 6).alias("mean"))


@query("source_summary", "SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS label, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return rel.summary(t.documents, "lang")


@query("lifecycle_distribution", "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return rel.summary(t.orders, "o_orderstatus")


@query("exclusive_membership", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def _(t):
    return rel.exclusive(t.orders, "o_custkey", "o_orderstatus")


@query("dup_keys", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return rel.duplicates(t.customer, "c_nationkey")


@query("version_sequence", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_sequence FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_sequence"))


@query("feature_summary", "SELECT 'quality' AS feature, round(min(quality), 6)::double AS least, round(max(quality), 6)::double AS most, round(avg(quality), 6) AS mean FROM labels UNION ALL SELECT 'toxic', min(toxic)::double, max(toxic)::double, round(avg(toxic), 6) FROM labels")
def _(t):
    return rel.feature_summary(t.labels, ["quality", "toxic"])


@query("quality_summary", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(t):
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("toxicity_by_source", "SELECT source, count(*) AS n, sum(toxic)::bigint AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def _(t):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


FACETS = list(tx.FACET_KEYWORDS)


@query("facet_gaps", " UNION ALL ".join("SELECT lang, '%s' AS facet, round(avg(least(1.0, (%s) / 3.0)), 6) AS mean, round(avg(least(1.0, (%s) / 3.0)), 6) < 0.4 AS gap FROM documents GROUP BY lang" % ((f.lower(), *[" + ".join("contains(lower(text), '%s')::int" % w for w in ws)] * 2)) for f, ws in tx.FACET_KEYWORDS.items()))
def _(t):
    d = t.documents.select("lang", *[c.alias(n.lower()) for n, c in tx.facets(F.col("text")).items()])
    return rel.facet_gaps(d, ["lang"], [n.lower() for n in FACETS])


@query("text_coverage", "SELECT doc_id, round(least(1.0, coalesce(held, 0) / greatest(n_chars, 1)), 6)::double AS share, least(1.0, coalesce(held, 0) / greatest(n_chars, 1)) >= 0.95 AS covered FROM (SELECT doc_id, n_chars, list_sum(list_transform(string_split(text, chr(10)), lambda l: length(l)))::bigint AS held FROM documents)")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.length("line").alias("n"))
    return rel.coverage(lines, t.documents.select("doc_id", F.col("n_chars").alias("total")), "doc_id")


@query("ingestion_totals", "SELECT event_type, count(*) AS runs, round(sum(value), 4) AS chunks FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("chunks"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("primary_document", "SELECT conv_id, arg_min(role, turn) AS doc FROM (SELECT conv_id, role, turn, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations WHERE turn < 5) WHERE n >= 2 GROUP BY conv_id")
def _(t):
    c = t.conversations.where("turn < 5").withColumn("n", F.count("*").over(Window.partitionBy("conv_id", "role")))
    return c.where("n >= 2").groupBy("conv_id").agg(F.min_by("role", "turn").alias("doc"))


@query("latest_version", "SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1")
def _(t):
    got = rel.latest(t.lineitem, "l_orderkey", *[F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return got.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"))


@query("list_runs", "WITH e AS (SELECT user_id, event_id, (value::int) % 4 AS v FROM events), a AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR v <> lag(v) OVER w + 1 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) SELECT user_id, min(event_id) AS first, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) > 1")
def _(t):
    e = t.events.select("user_id", "event_id", (F.rint("value").cast("int") % 4).alias("v"))
    return rel.runs(e, "user_id", "event_id", "v")


@query("text_runs", "SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS run FROM (SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS b FROM conversations)")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.withColumn("b", ~F.col("role").eqNullSafe(F.lag("role").over(w)))
    return rel.boundaries_sum(c, "conv_id", "turn", F.col("b")).select("conv_id", "turn", "run")


@query("sentence_windows", "SELECT conv_id, turn, items FROM (SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS items, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE len(items) = 3 OR n < 3 AND r = 1")
def _(t):
    return rel.sliding(t.conversations, "conv_id", "turn", "role")


@query("chunk_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::int - 1 AS ord FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("ord"))


@query("rate_limit_windows", "SELECT user_id, (floor(epoch(ts) / 60) * 60)::bigint AS window_start, count(*) AS n, least(count(*), 2) AS allowed FROM events GROUP BY ALL")
def _(t):
    r = rel.rate_windows(t.events, "user_id", "ts", 2)
    return r.groupBy("user_id", "window_start").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


@query("history_window", "SELECT conv_id, turn, right(text, 300) AS text FROM (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE n <= 6 AND (s <= 300 OR n = 1)")
def _(t):
    return rel.history(t.conversations, "conv_id", "turn", "text", 6, 300).select("conv_id", "turn", "text")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000 OR o_totalprice = 250000 AND o_orderkey > 10 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return rel.after_cursor(t.orders, [250000.0, 10], [("o_totalprice", True), ("o_orderkey", False)], 50).select("o_orderkey", "o_totalprice")


@query("keyset_next", "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS total FROM orders WHERE o_totalprice < 250000 OR o_totalprice = 250000 AND o_orderkey > 10) SELECT o_totalprice, o_orderkey FROM r WHERE n = 50 AND total > 50")
def _(t):
    return rel.next_cursor(t.orders, [250000.0, 10], [("o_totalprice", True), ("o_orderkey", False)], 50)


@query("recent_distinct", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f)::int AS rank FROM (SELECT user_id, event_type, min(r) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY ALL)")
def _(t):
    return rel.recent_distinct(t.events, "user_id", "event_type", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "rank")


@query("due_searches", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def _(t):
    return t.orders.where(F.col("o_orderdate") <= F.lit("1995-01-01").cast("timestamp")).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("feedback_newest", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def _(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id", "user_id")


@query("worst_chunks", "SELECT conv_id, turn, length(text)::int AS n FROM conversations ORDER BY length(text), conv_id, turn LIMIT 5")
def _(t):
    return t.conversations.select("conv_id", "turn", F.length("text").alias("n")).orderBy("n", "conv_id", "turn").limit(5)


@query("auto_ingest", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 1000) WHERE r <= 3")
def _(t):
    return t.documents.where("n_chars >= 1000").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 3").select("source", "doc_id")

RANKED = "ranked AS (SELECT doc_id % 40 AS query_id, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS rank FROM documents), relevant AS (SELECT doc_id % 40 AS query_id, doc_id AS id FROM labels WHERE quality = 1)"
METRICS = f"WITH {RANKED}, s AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN relevant USING (query_id, id) WHERE rank <= 10 GROUP BY 1), m AS (SELECT query_id, round(coalesce(hits / n, 0), 6)::double AS recall, round(coalesce(1.0::double / first, 0), 6)::double AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 0), 6)::double AS ndcg FROM s LEFT JOIN h USING (query_id))"


def metrics(t):
    ranked = t.documents.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy(F.col("doc_id") % 40).orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    relevant = t.labels.where("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"))
    return ev.ranking_metrics(ranked, relevant, 10)


@query("eval_ranking", METRICS + " SELECT * FROM m")
def _(t):
    return metrics(t)


@query("eval_summary", METRICS + " SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m")
def _(t):
    return ev.summary(metrics(t))


@query("drift_recall", METRICS + " SELECT query_id, recall, round(recall - 0.1, 6) AS delta, round(recall - 0.1, 6) <= -0.1 AS alert FROM m")
def _(t):
    m = metrics(t).select("query_id", "recall")
    return ev.drift(m, m.select("query_id", F.lit(0.1).alias("recall")), "query_id")


@query("document_coverage", "SELECT o_custkey, round(least(1.0, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') / count(DISTINCT o_orderkey)), 6)::double AS share FROM orders GROUP BY 1")
def _(t):
    o = t.orders.groupBy("o_custkey").agg(F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("h"), F.countDistinct("o_orderkey").alias("n"))
    return o.select("o_custkey", F.round(F.least(F.lit(1.0), F.col("h") / F.col("n")), 6).alias("share"))


@query("weight_learning", "WITH e AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 2.0::double ELSE 1.0 END AS f, value, value / 2 AS half FROM events), s AS (SELECT user_id, 'confidence' AS feature, sum(f * value) AS s FROM e WHERE value > 0 GROUP BY 1 UNION ALL SELECT user_id, 'section_match', sum(f * half) FROM e WHERE half > 0 GROUP BY 1), w AS (SELECT user_id, feature, 0.5 * s / sum(s) OVER (PARTITION BY user_id) + 0.5 * CASE feature WHEN 'confidence' THEN 0.3 ELSE 0.2 END AS w FROM s) SELECT user_id, feature, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS weight FROM w")
def _(t):
    e = t.events.select("user_id", F.col("event_type").alias("feedback_type"), F.create_map(F.lit("confidence"), F.col("value"), F.lit("section_match"), F.col("value") / 2).alias("features"))
    return ev.learned_weights(e, ["user_id"], {"confidence": 0.3, "section_match": 0.2})


@query("session_activity", "SELECT user_id, sum(n)::bigint AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS n FROM events) GROUP BY 1")
def _(t):
    s = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTE"), F.lit(True))
    return s.withColumn("n", new.cast("int")).groupBy("user_id").agg(F.sum("n").alias("sessions"))


@query("event_dedupe", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
