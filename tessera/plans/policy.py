"""Queries over predicates, policies, lifecycle and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graphs as gr
from ..operators import lifecycle as lc
from ..operators import policy as po
from .registry import query
from .scalars import HOST, PATH

STATE = "CASE doc_id % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'retired' WHEN 2 THEN 'active' END"


def state():
    return F.when(F.col("doc_id") % 5 == 0, "deleted").when(F.col("doc_id") % 5 == 1, "retired").when(F.col("doc_id") % 5 == 2, "active")


@query("scope_strict", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND doc_id % 4 <> 3")
def _(t):
    d = t.documents.select("doc_id", F.col("lang").alias("case_id"), F.col("source").alias("collection_id"), F.when(F.col("doc_id") % 4 == 3, "false").when(F.col("doc_id") % 4 == 2, "true").alias("is_latest"))
    return d.where(po.scope({"collection_ids": ["src1", "src2", "src1"], "tenant": " ", "case_id": "fr"}, case_id="en")).select("doc_id")


@query("scope_union", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR lang = 'en'")
def _(t):
    d = t.documents.select("doc_id", F.col("lang").alias("case_id"), F.col("source").alias("collection_id"), F.lit(None).cast("string").alias("is_latest"))
    return d.where(po.scope({"collection_ids": ["src1", "src2"], "case_id": "en"}, mode="union")).select("doc_id")


@query("visibility", f"SELECT doc_id, coalesce({STATE}, 'active') = 'active' AND doc_id % 3 <> 0 AS active, NOT (coalesce({STATE}, 'active') = 'active' AND doc_id % 3 <> 0) AS deleted, true AS everything FROM documents")
def _(t):
    chunk = F.when(F.col("doc_id") % 3 == 0, "deleted")
    return t.documents.select("doc_id", po.visible(state(), chunk).alias("active"), po.visible(state(), chunk, "deleted", True).alias("deleted"), po.visible(state(), chunk, "all", True).alias("everything"))


@query("document_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'is')")
def _(t):
    return t.documents.where(po.contains_all(F.col("text"), F.lit("The and IS "))).select("doc_id")


@query("permission_filter", "SELECT o_custkey AS user_id, o_orderkey AS document_id FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("document_id"), "o_orderpriority")
    return po.permitted(o.drop("o_orderpriority"), o.where(F.col("o_orderpriority").startswith("1")))


@query("case_access", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_custkey % 2 = 0 WHEN 'MACHINERY' THEN CASE WHEN c_nationkey < 5 THEN true WHEN c_nationkey < 10 THEN c_custkey % 3 = 0 ELSE c_custkey % 2 = 0 END ELSE c_custkey % 2 = 0 END AS allowed FROM customer")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    account = F.when(F.col("c_mktsegment") == "BUILDING", "EXTERNAL").when(F.col("c_mktsegment") == "MACHINERY", "ENTERPRISE").otherwise("OTHER")
    role = F.when(n < 5, "LEGAL").when(n < 10, "WORKS_COUNCIL").otherwise("USER")
    return t.customer.select("c_custkey", po.case_access(account, role, k % 2 == 0, k % 3 == 0).alias("allowed"))


@query("account_active", "SELECT o_orderkey, o_orderkey % 2 = 0 AND NOT (o_orderkey % 3 = 0 AND TIMESTAMP '1996-01-01' >= o_orderdate) AS active FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", po.is_active_account(F.when(k % 3 == 0, "EXTERNAL").otherwise("ENTERPRISE"), k % 2 == 0, F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp")).alias("active"))


@query("guardrail_gate", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'host_blocklisted' WHEN lang = 'es' THEN 'mime_blacklisted' WHEN n_chars > 5000 THEN 'document_too_large' WHEN n_chars / 1000.0 > 4 THEN 'processing_time_exceeded' WHEN docs + 1 > 40 OR bytes + n_chars > 60000 THEN 'tenant_quota_exceeded' ELSE 'allow' END AS decision FROM (SELECT *, count(*) OVER w - 1 AS docs, sum(n_chars) OVER w - n_chars AS bytes FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))")
def _(t):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = t.documents.withColumn("docs", F.count("*").over(w) - 1).withColumn("bytes", F.sum("n_chars").over(w) - F.col("n_chars"))
    limits = {"host_blocklist": ["src3"], "mime_blacklist": ["es"], "max_document_bytes": 5000, "processing_time_limit": 4.0, "max_documents": 40, "max_bytes": 60000}
    return d.select("doc_id", po.guardrail(F.col("source"), F.col("lang"), F.col("n_chars"), F.col("n_chars") / 1000, F.col("docs"), F.col("bytes"), limits).alias("decision"))


@query("fetch_status", "SELECT event_id, CASE WHEN value > 80 THEN 'policy_denied' WHEN s IS NULL THEN CASE WHEN event_type = 'click' THEN 'gone' ELSE 'temporary_error' END WHEN s = 304 THEN 'not_modified' WHEN s IN (404, 410) THEN 'gone' WHEN s >= 200 AND s < 300 THEN 'fetched' WHEN s IN (401, 403, 451) THEN 'policy_denied' WHEN s IN (429, 500, 502, 503, 504) THEN 'temporary_error' WHEN event_type = 'click' THEN 'gone' ELSE 'temporary_error' END AS status FROM (SELECT *, ([200, 304, 404, 403, 429, 418, NULL])[event_id % 7 + 1] AS s FROM events)")
def _(t):
    s = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 304, 404, 403, 429, 418, None)]), (F.col("event_id") % 7 + 1).cast("int"))
    v = po.fetch_violations(F.col("value"), F.lit(1), F.lit("text/html"), {"max_bytes": 80, "timeout": 5, "mime_whitelist": ["text/html"]})
    return t.events.select("event_id", po.fetch_status(v, s, F.when(F.col("event_type") == "click", "permanent")).alias("status"))


@query("robots", f"SELECT page_id, NOT (CASE WHEN p LIKE '/en/1%' THEN 5 WHEN p LIKE '/en%' THEN 3 ELSE -1 END > CASE WHEN p LIKE '/en/12%' THEN 6 WHEN p LIKE '/e%' THEN 2 ELSE -1 END) AS allowed FROM (SELECT page_id, {PATH} AS p FROM pages)")
def _(t):
    lit = lambda *x: F.array(*map(F.lit, x))
    return t.pages.select("page_id", po.robots_allowed(urls.path(F.col("url")), lit("/e", "/en/12"), lit("/en", "/en/1", "")).alias("allowed"))


@query("domain_policy", f"SELECT DISTINCT host, CASE WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'reject' WHEN host LIKE '%.example.com' THEN 'boost' ELSE 'neutral' END AS action, CASE WHEN host LIKE '%.example.org' THEN 90 WHEN host LIKE '%.example.com' THEN 70 END AS priority FROM (SELECT {HOST} AS host FROM pages)")
def _(t):
    rules = t.spark.createDataFrame([("example.org", "reject", 90), ("org", "boost", 90), ("example.com", "boost", 70)], "suffix string, action string, priority int")
    return po.domain_policy(t.pages.select(urls.host(F.col("url")).alias("host")), rules)


@query("answer_guardrail", "SELECT conv_id AS query_id, CASE WHEN count(*) < 3 THEN 'too_few_snippets' WHEN max(1.0 / turn_) < 0.3 THEN 'low_score' ELSE 'ok' END AS verdict FROM (SELECT conv_id, 1 + length(text) % 9 AS turn_ FROM conversations) GROUP BY conv_id")
def _(t):
    return po.answer_guardrail(t.conversations.select(F.col("conv_id").alias("query_id"), (1 / (1 + F.length("text") % 9)).alias("score")), 3, 0.3)


@query("routing_resolution", "SELECT doc_id AS id, CASE WHEN source = 'src1' AND lang = 'en' THEN 'late' WHEN source = 'src1' THEN 'agentic' WHEN lang = 'fr' THEN 'late' WHEN lang = 'es' THEN 'a' ELSE 'standard' END AS profile, lang = 'es' AND source <> 'src1' AS conflict FROM documents")
def _(t):
    rules = t.spark.createDataFrame([("src1", None, None, "en", None, "late"), ("src1", None, None, None, None, "agentic"), (None, None, None, "fr", None, "late"), (None, None, None, "es", None, "a"), (None, None, None, "es", None, "b")], ", ".join(f"{c} string" for c in po.SELECTORS) + ", profile string")
    none = F.lit(None).cast("string")
    items = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("collection_id"), none.alias("workflow_id"), none.alias("process"), F.col("lang").alias("doc_class"), none.alias("tenant"))
    return po.routed(items, rules, "standard")


@query("recrawl_interval", "SELECT event_id, round(i * CASE WHEN fr > 0 THEN least(2.0, 1 + fr / i) ELSE 1.0 END, 3)::double AS seconds FROM (SELECT event_id, value * 100 AS fr, least(base, CASE WHEN value > 0 THEN value * 1000 ELSE base END) * CASE WHEN event_id % 8 > 0 THEN 1 + least(5, event_id % 8) * 0.5 ELSE 1.0 END AS i FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 3600.0::double WHEN 1 THEN 86400.0 ELSE 604800.0 END AS base FROM events))")
def _(t):
    i = F.col("event_id")
    f = F.when(i % 3 == 0, "frequent").when(i % 3 == 2, "infrequent").otherwise("standard")
    return t.events.select("event_id", F.round(po.recrawl_seconds(f, F.lit(None).cast("double"), F.col("value") * 1000, i % 8, F.col("value") * 100), 3).alias("seconds"))


@query("frontier_decision", "SELECT event_id, CASE WHEN event_id % 50 = 0 OR f >= 5 THEN 'retire' WHEN event_id % 7 = 0 THEN 'skip' WHEN greatest(CASE WHEN event_id % 2 = 0 THEN 900 + 10 * value ELSE 0 END, CASE WHEN f >= 3 THEN 1000 + 60 * f ELSE 0 END) > 1000 THEN 'defer' ELSE 'enqueue' END AS action FROM (SELECT *, event_id % 6 AS f FROM events)")
def _(t):
    i = F.col("event_id")
    f = po.frontier(i % 50 == 0, i % 6, i % 7 != 0, F.when(i % 2 == 0, F.lit(900.0)), F.col("value") * 10, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1000.0))
    return t.events.select("event_id", f["action"].alias("action"))


@query("transitions", "SELECT event_id, CASE b WHEN 'active' THEN true WHEN 'retired' THEN true WHEN 'deleted' THEN a = 'deleted' ELSE true END AS ok FROM (SELECT event_id, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b, s AS a FROM (SELECT *, (['active', 'retired', 'deleted'])[event_id % 3 + 1] AS s FROM events))")
def _(t):
    s = F.element_at(F.array(F.lit("active"), F.lit("retired"), F.lit("deleted")), (F.col("event_id") % 3 + 1).cast("int"))
    e = t.events.withColumn("s", s).withColumn("b", F.lag("s").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("event_id", po.transition_ok(F.col("b"), F.col("s")).alias("ok"))


@query("dead_letter_expiry", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE event_id < 5000 - 3600 END AS expired FROM events")
def _(t):
    payload = F.when(F.col("event_id") % 4 == 0, '{"dead_lettered_at": "x"}').otherwise(F.concat(F.lit('{"dead_lettered_at": '), "event_id", F.lit("}")))
    return t.events.select("event_id", po.expired_letters(payload, F.lit(5000.0), 3600).alias("expired"))


@query("upsert_decision", "WITH s AS (SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 2 = 0), held AS (SELECT h, min(key) AS holder FROM s GROUP BY h) SELECT d.doc_id AS key, CASE WHEN s.h = md5(d.text) THEN 'skipped' WHEN s.h IS NOT NULL THEN 'replaced' WHEN holder IS NOT NULL THEN 'linked' WHEN d.doc_id % 11 = 0 THEN CASE WHEN d.doc_id % 22 = 0 THEN 'near_duplicate_replaced' ELSE 'near_duplicate_skipped' END ELSE 'inserted' END AS action FROM documents d LEFT JOIN s ON s.key = d.doc_id LEFT JOIN held ON held.h = md5(d.text)")
def _(t):
    new = t.documents.select(F.col("doc_id").alias("key"), F.md5("text").alias("hash"))
    stored = t.documents.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hash"))
    near = t.documents.where(F.col("doc_id") % 11 == 0).select(F.col("doc_id").alias("key"), F.lit(0).alias("other"), (F.col("doc_id") % 22 == 0).alias("replaces"))
    return lc.upsert_decisions(new, stored, near)


@query("exact_delta", "SELECT doc_id AS key, CASE WHEN doc_id % 2 = 1 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status, (CASE WHEN doc_id % 2 = 1 THEN 1 WHEN doc_id % 3 = 0 THEN 5 ELSE 4 END)::int AS version FROM documents")
def _(t):
    new = t.documents.select(F.col("doc_id").alias("key"), F.md5("text").alias("hash"))
    old = t.documents.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.md5("text")).alias("hash"), F.lit(4).alias("version"))
    return lc.delta(new, old.union(old.select("key", F.lit("older"), F.lit(1))))


@query("version_replace", "SELECT l_orderkey AS document, l_linenumber AS version, count(*) AS n, bool_and(l_orderkey % 2 <> 0) AS latest FROM lineitem WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber = 1) GROUP BY ALL UNION ALL SELECT DISTINCT l_orderkey, 1, 1, true FROM lineitem WHERE l_orderkey % 2 = 0")
def _(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("version"), F.lit(0).alias("ord"), F.lit(True).alias("is_latest"))
    new = c.where("document % 2 = 0").select("document", F.lit(1).alias("version"), F.lit(0).alias("ord")).distinct()
    return lc.replace_version(c, new).groupBy("document", "version").agg(F.count("*").alias("n"), F.bool_and("is_latest").alias("latest"))


@query("lifecycle_update", "SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'retired' ELSE 'active' END AS lifecycle FROM documents")
def _(t):
    return lc.set_state(t.documents.select("doc_id", F.lit("active").alias("lifecycle")), t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "retired")


@query("hard_delete", "SELECT (SELECT count(*) FROM documents WHERE doc_id < 100) AS documents, (SELECT count(*) FROM labels WHERE doc_id < 100) AS chunks")
def _(t):
    return lc.hard_delete(t.documents, t.labels, t.documents.where("doc_id < 100"), "doc_id")[2]


@query("collection_delete", "SELECT doc_id, nullif(source, 'src1') AS collection_id FROM documents")
def _(t):
    d = t.documents.select("doc_id", F.col("source").alias("collection_id"))
    return lc.drop_collection(d, d, "src1")[0]


@query("ensure_links", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def _(t):
    c = t.customer.select("c_nationkey", "c_mktsegment")
    return lc.add_missing(c.where("c_nationkey < 10").distinct(), c, ["c_nationkey", "c_mktsegment"])


@query("collection_merge", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def _(t):
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return lc.merge_duplicates(c, c.select("c_custkey"), "c_nationkey", "c_custkey", F.col("c_custkey"))[0].select("c_nationkey", "c_custkey")


@query("retention_purge", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def _(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderdate").cast("timestamp")).alias("deleted_at"))
    return lc.purge(o, "deleted_at", F.lit("1998-01-01").cast("timestamp")).select("o_orderkey")


@query("phase_fold")
def _(t):
    moves = [("click", "open", "seen"), ("purchase", None, "closed"), ("view", "closed", "open"), ("signup", "seen", "open")]
    return lc.replay(t.events, "user_id", ["ts", "event_id"], moves, "open")


@query("run_states", "SELECT user_id, 'completed' AS state FROM events GROUP BY user_id HAVING bool_or(event_id % 3 = 2) UNION ALL SELECT user_id, 'running' FROM events GROUP BY user_id HAVING NOT bool_or(event_id % 3 = 2) AND bool_or(event_id % 3 = 1) UNION ALL SELECT user_id, 'queued' FROM events GROUP BY user_id HAVING NOT bool_or(event_id % 3 > 0)")
def _(t):
    s = F.element_at(F.array(F.lit("queued"), F.lit("running"), F.lit("completed")), (F.col("event_id") % 3 + 1).cast("int"))
    return lc.run_states(t.events.select("user_id", "event_id", s.alias("state")), "user_id", "event_id")


@query("bulk_ingest", "SELECT count(*) FILTER (WHERE length(text) <= 256) AS ok, count(*) FILTER (WHERE length(text) > 256) AS failed FROM documents")
def _(t):
    ok, bad = lc.split_valid(t.documents, po.contract_errors(F.col("text"), F.array(F.col("lang")), F.col("lang"), F.lit("a/b")))
    return ok.agg(F.count("*").alias("ok")).crossJoin(bad.agg(F.count("*").alias("failed")))


@query("changed_fields", "SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'lang' END, CASE WHEN doc_id % 3 = 0 THEN 'source' END], lambda x: x IS NOT NULL) AS fields FROM documents")
def _(t):
    old, new = F.struct("lang", "source"), F.struct(F.when(F.col("doc_id") % 2 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"))
    return t.documents.select("doc_id", old.alias("old"), new.alias("new")).select("doc_id", lc.changed_fields(["lang", "source"]).alias("fields"))


def chunks(t):
    i = F.col("conv_id") * 1000 + F.col("turn")
    return t.conversations.select(i.alias("id"), F.col("conv_id").alias("document"), F.col("role").alias("section"), F.col("turn").alias("ord"), F.when(F.col("turn") > 0, F.array(F.col("conv_id") * 1000)).otherwise(F.array().cast("array<bigint>")).alias("parents"), F.array(i + 2).alias("refs"))


ADJ = "c AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, turn FROM conversations), n AS (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id, role ORDER BY turn, id) AS dst FROM c), adj AS (SELECT src, dst FROM n WHERE dst IS NOT NULL UNION SELECT dst, src FROM n WHERE dst IS NOT NULL)"


@query("evidence_edges", f"WITH {ADJ} SELECT src, dst, 'adjacent' AS kind FROM adj UNION SELECT c.id, c.conv_id * 1000, 'parent' FROM c JOIN c p ON p.id = c.conv_id * 1000 WHERE c.turn > 0 UNION SELECT c.conv_id * 1000, c.id, 'child' FROM c JOIN c p ON p.id = c.conv_id * 1000 WHERE c.turn > 0 UNION SELECT c.id, c.id + 2, 'reference' FROM c JOIN c d ON d.id = c.id + 2 UNION SELECT c.id + 2, c.id, 'backref' FROM c JOIN c d ON d.id = c.id + 2")
def _(t):
    return gr.edges(chunks(t))


@query("adjacency_edges", f"WITH {ADJ} SELECT * FROM adj")
def _(t):
    return gr.edges(chunks(t)).where("kind = 'adjacent'").select("src", "dst")


@query("khop", f"WITH {ADJ}, h1 AS (SELECT s.id AS seed, a.dst AS id FROM c s JOIN adj a ON a.src = s.id WHERE s.turn = 0), h2 AS (SELECT h1.seed, a.dst AS id FROM h1 JOIN adj a ON a.src = h1.id) SELECT seed, id, min(hop)::int AS hop FROM (SELECT id AS seed, id, 0 AS hop FROM c WHERE turn = 0 UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) GROUP BY ALL")
def _(t):
    c = chunks(t)
    return gr.hops(gr.edges(c), c.where("ord = 0"), 2)


@query("subgraph", f"WITH {ADJ} SELECT src, dst FROM adj WHERE src % 1000 < 4 AND dst % 1000 < 4")
def _(t):
    c = chunks(t)
    return gr.induced(gr.edges(c).where("kind = 'adjacent'"), c.where("ord < 4")).select("src", "dst")


@query("graph_parents", "SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id * 1000 AS parent FROM conversations c WHERE c.turn > 0 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = 0)")
def _(t):
    return gr.parents(gr.edges(chunks(t)))


@query("graph_references", "WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn * 2 AS one, (conv_id + 1) * 1000 AS two FROM conversations), r AS (SELECT id AS src, unnest([one, two, one]) AS dst FROM c), e AS (SELECT DISTINCT src, dst FROM r JOIN c ON c.id = dst) SELECT src, dst, 'reference' AS kind FROM e UNION ALL SELECT dst, src, 'backref' FROM e")
def _(t):
    key, none = F.col("conv_id") * 1000 + F.col("turn"), F.array().cast("array<long>")
    refs = F.array(F.col("conv_id") * 1000 + F.col("turn") * 2, (F.col("conv_id") + 1) * 1000, F.col("conv_id") * 1000 + F.col("turn") * 2)
    c = t.conversations.select(key.alias("id"), F.col("conv_id").alias("document"), F.col("role").alias("section"), F.col("turn").alias("ord"), none.alias("parents"), refs.alias("refs"))
    return gr.edges(c).where("kind in ('reference', 'backref')")
