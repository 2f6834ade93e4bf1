"""Queries over lookups around retrieval, policies of masking and office files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import lookups as lk
from ..sources import files
from ..streaming import timers
from .documents import scratch, stream
from .registry import query

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@query("chunks_by_version", "SELECT l_orderkey AS document, l_linestatus AS version, l_linenumber AS ord, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber)::int AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus) WHERE place BETWEEN 2 AND 4")
def _(t):
    chunks = t.lineitem.select(F.lit("t").alias("tenant"), F.col("l_orderkey").alias("document"), F.col("l_linestatus").alias("version"), F.col("l_linenumber").alias("ord"))
    wanted = t.orders.select(F.lit("t").alias("tenant"), F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("version"))
    return lk.of_version(chunks, wanted, limit=3, offset=1).select("document", "version", "ord", "place")


CUT = "left(whole, list_max(list_filter(range(0, 65), lambda n: strlen(left(whole, n)) <= 64)))"


@query("parent_context", f"""SELECT tenant_id, document, parent_id, CASE WHEN strlen(whole) > 64 THEN {CUT} ELSE whole END AS content, strlen(whole)::int AS content_bytes, strlen(whole) > 64 AS truncated
  FROM (SELECT lang AS tenant_id, doc_id AS document, 'd' || doc_id AS parent_id, text AS whole FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT lang, doc_id, 'source', source FROM documents WHERE doc_id % 5 <> 0) WHERE whole IS NOT NULL""")
def _(t):
    d, key = t.documents, F.col("doc_id")
    own = F.concat(F.lit("d"), key)
    parents = d.select(F.col("lang").alias("tenant_id"), key.alias("document"), F.create_map(own, F.col("text"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("parents"))
    ids = F.array(F.when(key % 3 != 0, F.concat(F.lit(" "), own)), F.lit("source "), F.lit(" "), F.lit("none"))
    asked = d.select(F.when(key % 5 != 0, F.col("lang")).otherwise("other").alias("tenant_id"), key.alias("document"), F.explode(ids).alias("parent_id"))
    return lk.parent_context(parents, asked, 64)


@query("embedding_cache_ttl", f"""SELECT vec_id::varchar AS text_hash, CASE WHEN vec_id % 3 = 0 THEN {NOW} - INTERVAL 1 DAY ELSE {NOW} - to_days(label * 20) END AS created_at
  FROM embeddings WHERE vec_id % 7 <> 0 AND CASE WHEN vec_id % 3 = 0 THEN true ELSE vec_id % 2 = 0 AND label * 20 < 90 END""")
def _(t):
    e = t.embeddings.withColumn("text_hash", F.col("vec_id").cast("string"))
    created = now() - F.make_interval(days=F.col("label") * 20)
    old = e.select("text_hash", F.when(F.col("vec_id") % 2 == 0, "m1").otherwise("m0").alias("model_version"), "embedding", created.alias("created_at"), (created + F.expr("INTERVAL 90 DAYS")).alias("expires_at"))
    cache = lk.cache_put(old, e.where("vec_id % 3 = 0"), "m1", now() - F.expr("INTERVAL 1 DAY"))
    got = lk.cache_get(cache, e.where("vec_id % 7 <> 0"), "m1", now())
    return got.select("text_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


SCOPE = """SELECT o_orderkey AS id, coalesce(o_orderstatus, '') AS tenant, list_filter([CASE WHEN h IS NULL THEN 'tenant_missing' WHEN h <> 'O' THEN 'tenant_mismatch' END,
  CASE WHEN w IS NOT NULL AND c IS NULL THEN 'case_missing' WHEN c <> w THEN 'case_mismatch' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, CASE WHEN o_custkey % 10 <> 0 THEN o_orderstatus END AS h, CASE WHEN o_orderkey % 4 <> 0 THEN left(o_orderpriority, 1) END AS c, CASE WHEN o_orderkey % 2 = 0 THEN '1' END AS w FROM orders)"""


def scoped(t):
    o, key = t.orders, F.col("o_orderkey")
    return o.select(key.alias("id"), "o_orderstatus", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderstatus")).alias("tenant"), F.when(key % 4 != 0, F.substring("o_orderpriority", 1, 1)).alias("case"), F.lit("O").alias("asked_tenant"), F.when(key % 2 == 0, "1").alias("asked_case"))


@query("scope_reasons", SCOPE)
def _(t):
    reasons = lk.scope_reasons(*map(F.col, ("tenant", "case", "asked_tenant", "asked_case")))
    return scoped(t).select("id", F.col("o_orderstatus").alias("tenant"), reasons.alias("reasons"))


@query("scope_recheck", f"SELECT id FROM ({SCOPE}) WHERE len(reasons) = 0")
def _(t):
    return lk.recheck_scope(scoped(t)).select("id")


@query("contents_table", """WITH p AS (SELECT conv_id AS document, turn AS ord, 0 AS pos, 'role-' || role AS id, role AS title, 'section' AS kind, 1 AS level, length(role) AS o FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'doc', 'whole', 'document', 0, 0 FROM conversations),
  f AS (SELECT document, id, arg_min({'title': title, 'kind': kind, 'level': level, 'o': o, 'ord': ord, 'pos': pos}, ord * 10 + pos) AS f FROM p GROUP BY ALL)
  SELECT document, row_number() OVER (PARTITION BY document ORDER BY f.level, f.o, f.ord, f.pos)::int AS position, id, f.title AS title, f.kind AS kind, f.level AS level FROM f""")
def _(t):
    node = lambda id_, title, kind, level, order: F.struct(id_.alias("id"), title.alias("title"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), order.alias("order"))
    role, zero = F.col("role"), F.lit(0)
    parents = F.array(node(F.concat(F.lit("role-"), role), role, "section", 1, F.length("role")), node(F.lit("doc"), F.lit("whole"), "document", 0, zero), node(F.lit("p"), role, "paragraph", 2, zero))
    return lk.contents_table(t.conversations.select(F.col("conv_id").alias("document"), F.col("turn").alias("ord"), parents.alias("parents")))


@query("search_alerts", """WITH s AS (SELECT n_nationkey AS search_id, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' END AS source, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::varchar ELSE '' END AS case_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'R#00' || n_nationkey % 5 END AS q, CASE WHEN n_nationkey % 4 <> 0 THEN 1000.0 END AS last FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey <= 20),
  h AS (SELECT search_id, c_custkey AS document, row_number() OVER (PARTITION BY search_id ORDER BY c_acctbal, c_custkey)::int AS rank FROM s JOIN customer ON (last IS NULL OR c_acctbal > last) AND (source IS NULL OR source = c_mktsegment) AND (case_id = '' OR case_id = c_nationkey::varchar) AND (q IS NULL OR contains(lower(c_name), lower(q)) OR contains(c_custkey::varchar, lower(q))))
  SELECT * FROM h WHERE rank <= 50""")
def _(t):
    n, none = F.col("n_nationkey"), F.lit(None).cast("string")
    searches = t.nation.select(n.alias("search_id"), (n % 7 != 0).alias("enabled"), n.alias("next_run"), F.when(n % 4 != 0, 1000.0).alias("last_run"), F.when(n % 5 != 0, F.concat(F.lit("R#00"), n % 5)).alias("query"), F.when(n % 3 == 0, n.cast("string")).otherwise("").alias("case_id"), F.when(n % 2 == 0, "BUILDING").alias("source"), none.alias("workflow_id"), none.alias("collection_id"))
    docs = t.customer.select(F.col("c_custkey").alias("document"), F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_acctbal").alias("updated_at"), F.col("c_nationkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("source"), none.alias("workflow_id"), none.alias("collection_id"))
    return lk.search_alerts(searches, docs, F.lit(20))


@query("delivery_retries", f"""WITH d AS (SELECT event_id AS id, (event_id % 5)::int AS attempts, ts AS next_attempt, event_id % 11 <> 0 AS known, event_type = 'click' AS sent FROM events WHERE event_id % 3 <> 0 AND ts <= {NOW} ORDER BY ts, event_id LIMIT 100),
  r AS (SELECT id, CASE WHEN NOT known THEN 'skipped' WHEN sent THEN 'sent' WHEN attempts >= 4 THEN 'failed' ELSE 'pending' END AS status, (attempts + known::int)::int AS attempts, next_attempt FROM d)
  SELECT id, status, attempts, CASE WHEN status = 'pending' THEN {NOW} + to_seconds(60 * 2 ** (attempts - 1)) ELSE next_attempt END AS next_attempt FROM r""")
def _(t):
    e, key = t.events, F.col("event_id")
    pending = e.select(key.alias("id"), F.when(key % 3 != 0, "pending").otherwise("sent").alias("status"), (key % 5).alias("attempts"), F.col("ts").cast("timestamp").alias("next_attempt"), F.when(key % 11 != 0, "a@b").otherwise("").alias("address"), (F.col("event_type") == "click").alias("sent"))
    return lk.deliveries(pending, now()).withColumn("next_attempt", F.col("next_attempt").cast("timestamp_ntz"))


@query("dead_letter_sweep", """WITH s AS (SELECT event_type AS queue, ts, row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 150 AS scan FROM events), m AS (SELECT max(ts) AS m FROM events),
  c AS (SELECT queue, count(*) AS n, count(*) FILTER (WHERE scan) AS scanned, count(*) FILTER (WHERE scan AND epoch_us(m) - epoch_us(ts) > 86400000000) AS removed FROM s, m GROUP BY queue)
  SELECT queue, scanned, removed, scanned - removed AS kept, n - removed > 10 AS alert FROM c""")
def _(t):
    e = t.events.select(F.col("event_type").alias("queue"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("at"))
    last = e.agg(F.max("at")).first()[0]
    return lk.sweep(e, F.lit(last), 86_400, most=150)


@query("masking_policies")
def _(t):
    d = t.documents
    return d.select("doc_id", *[F.md5(pii.mask_by_policy(F.col("text"), p)).alias(p) for p in pii.POLICIES])


@query("source_mix_scores", "SELECT o_orderstatus, count(*) FILTER (WHERE v > 0 AND NOT l > 0) AS vector_only, count(*) FILTER (WHERE l > 0 AND NOT v > 0) AS lexical_only, count(*) FILTER (WHERE l > 0 AND v > 0) AS both_legs, count(*) FILTER (WHERE NOT l > 0 AND NOT v > 0) AS neither FROM (SELECT o_orderstatus, (o_orderkey % 3)::double AS v, coalesce((o_custkey % 2)::double, 0) AS l FROM orders) GROUP BY 1")
def _(t):
    s = t.orders.select("o_orderstatus", (F.col("o_orderkey") % 3).cast("double").alias("v"), (F.col("o_custkey") % 2).cast("double").alias("l"))
    v, x = F.coalesce("v", F.lit(0.0)) > 0, F.coalesce("l", F.lit(0.0)) > 0
    return s.groupBy("o_orderstatus").agg(F.count_if(v & ~x).alias("vector_only"), F.count_if(x & ~v).alias("lexical_only"), F.count_if(v & x).alias("both_legs"), F.count_if(~v & ~x).alias("neither"))


def written_as(kind: str):
    """The bytes of a file of that kind with a text's lines as its paragraphs, a slide's or a sheet's rows."""
    shapes = {
        "docx": ("word/document.xml", "<document><body>%s</body></document>", "<p><r><t>%s</t></r></p>"),
        "pptx": ("ppt/slides/slide1.xml", "<sld>%s</sld>", "<p><r><t>%s</t></r></p>"),
        "xlsx": ("xl/worksheets/sheet1.xml", "<worksheet><sheetData>%s</sheetData></worksheet>", "<row><c><v>%s</v></c></row>"),
    }
    part, whole, line = shapes[kind]

    def one(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(part, whole % "".join(line % escape(x) for x in (text or "").split("\n")))
        return out.getvalue()

    return F.pandas_udf(lambda s: s.map(one), "binary")


OFFICE = {"docx": "wordprocessingml.document", "pptx": "presentationml.presentation", "xlsx": "spreadsheetml.sheet"}
LINES = "regexp_replace(coalesce(text, ''), '[^a-zA-Z \\n]', '', 'g')"


@query("office_blocks", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({LINES}, chr(10)), lambda x: CASE WHEN doc_id % 3 = 2 THEN x ELSE trim(x) END), lambda x: x <> '') AS l FROM documents),
  b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN l ELSE CASE WHEN len(l) > 0 THEN [array_to_string(l, chr(10))] ELSE [] END END AS b FROM l)
  SELECT doc_id, (['paragraph', 'slide', 'table_summary'])[doc_id % 3 + 1] AS kind, len(b) AS blocks, md5(array_to_string(b, chr(10))) AS texts_md5 FROM b WHERE len(b) > 0""")
def _(t):
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z \n]", "")
    kinds = list(OFFICE)
    whole = None
    for k, kind in enumerate(kinds):
        d = t.documents.where(F.col("doc_id") % 3 == k).select(F.col("doc_id").alias("id"), F.lit(f"application/vnd.openxmlformats-officedocument.{OFFICE[kind]}").alias("media_type"), written_as(kind)(clean).alias("content"))
        whole = d if whole is None else whole.unionAll(d)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n")
    return files.parse(whole).groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count("*").alias("blocks"), F.md5(texts).alias("texts_md5"))


@query("text_and_image_blocks", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'paragraph' ELSE 'other' END AS kind, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || lang ELSE 'image/' || (['png', 'jpeg', 'gif', 'unknown'])[doc_id % 4 + 1] END AS texts FROM documents""")
def _(t):
    d, key = t.documents, F.col("doc_id")
    magic = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("89504E47", "FFD8FF", "474946383961", "00")]), (key % 4 + 1).cast("int"))
    text = F.encode(F.concat("source", F.lit(" \n \n\n"), "lang", F.lit("\n")), "UTF-8")
    f = d.select(key.alias("id"), F.when(key % 2 == 0, "text/plain").otherwise("image/any").alias("media_type"), F.when(key % 2 == 0, text).otherwise(magic).alias("content"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n")
    return files.parse(f).groupBy(F.col("id").alias("doc_id"), "kind").agg(texts.alias("texts"))


ALERTS = """WITH s AS (SELECT n_nationkey AS search_id, CASE n_nationkey % 3 WHEN 0 THEN 3600000 WHEN 1 THEN 86400000 ELSE 604800000 END AS every, CASE WHEN n_nationkey % 2 = 0 THEN 'click' ELSE '' END AS source, CASE WHEN n_nationkey % 5 <> 0 THEN 'k": ' || n_nationkey % 7 ELSE '' END AS q FROM nation WHERE n_nationkey % 6 <> 0),
 e AS (SELECT event_id, event_type, props, epoch_ms(ts) AS ms FROM events), m AS (SELECT search_id, event_id, ms, (ms // every + 1) * every AS due FROM s JOIN e ON (source = '' OR source = event_type) AND contains(lower(props), q))
 SELECT search_id, due::bigint AS run_at_ms, count(*) AS matches, (list(event_id ORDER BY ms, event_id))[1:50] AS documents FROM m WHERE due < (SELECT max(ms) FROM e) GROUP BY search_id, due"""


@query("stream_alerts", ALERTS)
def _(t):
    n = F.col("n_nationkey")
    searches = t.nation.select(
        n.alias("search_id"), (n % 6 != 0).alias("enabled"), F.when(n % 5 != 0, F.concat(F.lit('K": '), n % 7)).alias("query"), F.when(n % 3 == 0, "hourly").when(n % 3 == 1, "daily").otherwise("weekly").alias("frequency"), F.when(n % 2 == 0, "click").otherwise(" ").alias("source"),
    ).withColumn("source", F.trim("source"))
    events = stream(t).select(F.col("event_id").alias("document"), F.col("ts").alias("updated_at"), F.col("props").alias("text"), F.col("event_type").alias("source"))
    return timers.run(timers.alerts(events, searches), scratch(t, "alerts"))


@query("stream_sweeps", """WITH e AS (SELECT event_type AS queue, (epoch_ms(ts) + 86400000) // 7200000 * 7200000 + 7200000 AS due FROM events), l AS (SELECT max(epoch_ms(ts)) AS m FROM events),
 n AS (SELECT queue, due, count(*) AS removed FROM e GROUP BY ALL) SELECT queue, due::bigint AS swept_at_ms, removed, (sum(removed) OVER (PARTITION BY queue) - sum(removed) OVER (PARTITION BY queue ORDER BY due))::bigint AS kept, sum(removed) OVER (PARTITION BY queue) - sum(removed) OVER (PARTITION BY queue ORDER BY due) > 100 AS alert FROM n QUALIFY due < (SELECT m FROM l)""")
def _(t):
    letters = stream(t).select(F.col("event_type").alias("queue"), F.col("ts").alias("at"))
    return timers.run(timers.sweeps(letters, ttl=86_400, every=7200, alert=100), scratch(t, "sweeps"))
