"""Queries over URLs, masks, vectors and other scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii, scalars, urls, vectors
from .registry import query

SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PARAMS = "list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '')"
TRACKS = "(split_part(lower(p), '=', 1) IN (" + ", ".join(f"'{n}'" for n in urls.TRACKING_NAMES) + ") OR " + " OR ".join(f"starts_with(lower(p), '{n}')" for n in urls.TRACKING_PREFIXES) + ")"


def q(parts: str) -> str:
    return f"CASE WHEN len({parts}) > 0 THEN '?' || array_to_string({parts}, '&') ELSE '' END"


@query(
    "url_canonical",
    f"""SELECT page_id,
      {SCHEME} || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || {q(f'list_sort(list_filter({PARAMS}, lambda p: NOT {TRACKS}))')} AS canonical,
      {SCHEME} || '://' || {HOST} || {PATH} || {q(f'list_sort({PARAMS})')} AS normalized,
      {SCHEME} || '://' || {HOST} || {PATH} || {q(f"list_filter({PARAMS}, lambda p: NOT {TRACKS} AND contains(p, '=') AND split_part(p, '=', 2) <> '')")} AS cleaned FROM pages""",
)
def _(t):
    return t.pages.select("page_id", urls.canonical_source(F.col("url")).alias("canonical"), urls.normalized(F.col("url")).alias("normalized"), urls.cleaned(F.col("url")).alias("cleaned"))


@query("url_result_form")
def _(t):
    return t.pages.select("page_id", urls.result_form(F.col("url")).alias("form"), urls.provider_record(F.lit(" Web "), F.col("url"))["external_id"].alias("external_id"))


@query("host_traits", f"""SELECT page_id, CASE WHEN h LIKE '%.gov' OR h LIKE '%.gov.%' THEN 'government' WHEN h LIKE '%.edu' OR h LIKE '%.ac.%' THEN 'academic' WHEN h LIKE '%.org' THEN 'nonprofit'
   WHEN h LIKE 'intranet%' OR h LIKE '%.internal' OR h LIKE '%.corp' THEN 'internal' ELSE 'commercial' END AS domain_type,
   CASE WHEN h LIKE '%.gov' OR h LIKE '%.gov.%' OR h LIKE '%.edu' OR h LIKE '%.ac.%' THEN 'high' ELSE 'medium' END AS trust, lower({PATH}) LIKE '%.pdf' AS is_pdf FROM (SELECT *, {HOST} AS h FROM pages)""")
def _(t):
    kind, trust = urls.host_traits(F.col("url"))
    return t.pages.select("page_id", kind.alias("domain_type"), trust.alias("trust"), urls.is_pdf(F.col("url"), F.lit(None).cast("string")).alias("is_pdf"))


@query("url_dupes", f"SELECT c AS url_key, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, {HOST} || left({PATH}, 4) AS c FROM pages) GROUP BY c HAVING count(*) > 1")
def _(t):
    keyed = t.pages.select("page_id", F.concat(urls.host(F.col("url")), F.substring(urls.path(F.col("url")), 1, 4)).alias("url_key"))
    return keyed.groupBy("url_key").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


PHONE = r"([^\p{L}\p{M}\p{N}\p{Pc}]|^)(\+?\d[\d\s().-]{5,}\d)"


@query("pii_mask")
def _(t):
    return t.documents.select("doc_id", F.md5(pii.mask(F.col("text"))).alias("masked_md5"), *[c.alias(f"n_{k.lower()}") for k, c in pii.counts(F.col("text")).items()])


@query("pii_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))::int AS n_ipv4, len(regexp_extract_all(text, '\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b'))::int AS n_uuid, len(regexp_extract_all(text, '(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b'))::int AS n_iban FROM documents")
def _(t):
    c = pii.counts(F.col("text"))
    return t.documents.select("doc_id", c["IPV4"].alias("n_ipv4"), c["UUID"].alias("n_uuid"), c["IBAN"].alias("n_iban"))


@query("pii_jwt_mask", rf"SELECT doc_id, md5(regexp_replace(text, '{pii.JWT}', '[REDACTED_JWT_HEADER].[REDACTED_JWT_PAYLOAD].[REDACTED_JWT_SIGNATURE]', 'g')) AS masked_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(pii.mask_jwt(F.col("text"))).alias("masked_md5"))


@query("digit_fallback", r"SELECT doc_id, md5(CASE WHEN m = text THEN regexp_replace(text, '[0-9]', 'X', 'g') ELSE m END) AS out_md5 FROM (SELECT *, regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[REDACTED_IPV4]', 'g') AS m FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.md5(pii.digits_if_unmasked(F.col("text"), pii.mask(F.col("text"), only=["IPV4"]))).alias("out_md5"))


@query("pii_url_params")
def _(t):
    return t.pages.select("page_id", pii.mask_url_params(F.concat(F.col("url"), F.lit("&token=abc&x=1"))).alias("masked"))


@query("pii_pseudonyms")
def _(t):
    return t.documents.select("doc_id", F.md5(pii.pseudonyms("k")(F.col("text"))).alias("out_md5"), F.md5(pii.mask_cards(F.col("text"))).alias("cards_md5"))


@query("json_mask")
def _(t):
    return t.events.select("event_id", pii.mask_json(F.col("props")).alias("props"))


@query("vector_normalise", "SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm, round((embedding::double[])[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS first FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(F.sqrt(vectors.squared(F.col("embedding"))), 6).alias("norm"), F.round(vectors.unit(F.col("embedding"))[0], 6).alias("first"))


@query("vector_valid", "SELECT vec_id, len(embedding) = 64 AND list_dot_product(embedding::double[], embedding::double[]) > 1e-12 AS valid FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", vectors.is_valid(F.col("embedding"), 64).alias("valid"))


@query("vector_scores", """SELECT vec_id, round(1 - d*d/2, 6) AS as_cosine, round(1/(1+d), 6) AS inverse, round(greatest(0.0, 1-d), 6) AS linear, round(greatest(0.0, 1 - d/20), 6) AS by_cutoff
  FROM (SELECT e.vec_id, list_distance(e.embedding::double[], z.embedding::double[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z)""")
def _(t):
    zero = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("z"))
    d = t.embeddings.crossJoin(F.broadcast(zero)).select("vec_id", vectors.l2_distance(F.col("embedding"), F.col("z")).alias("d"))
    r = lambda c: F.round(c, 6)
    return d.select("vec_id", r(vectors.l2_to_cosine(F.col("d"))).alias("as_cosine"), r(vectors.inverse_score(F.col("d"))).alias("inverse"), r(vectors.linear_score(F.col("d"))).alias("linear"), r(vectors.cutoff_similarity(F.col("d"), 20.0)).alias("by_cutoff"))


@query("vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding::double[], lambda x: printf('%.6f', x)), ',') || ']' AS literal FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", vectors.literal(F.col("embedding")).alias("literal"))


@query("label_centroids", "SELECT label, pos - 1 AS pos, round(avg(x), 6) AS x, max(n) AS n FROM (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS pos, count(*) OVER (PARTITION BY label) / 1 AS n0, 0 AS z FROM embeddings) JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) GROUP BY label, pos")
def _(t):
    c = vectors.centroids(t.embeddings, "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"), "n")


@query("centroid_outliers", """WITH c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)
  SELECT label, count(*) AS n, count(*) FILTER (WHERE s < 0.3) AS outliers, round(avg(s), 6) AS mean FROM (SELECT label, list_cosine_similarity(embedding::double[], centroid) AS s FROM embeddings JOIN c USING (label)) GROUP BY label""")
def _(t):
    c = vectors.centroids(t.embeddings, "label", "embedding").select("label", "centroid")
    s = t.embeddings.join(c, "label").select("label", vectors.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("s") < 0.3).alias("outliers"), F.round(F.avg("s"), 6).alias("mean"))


@query("cosine_topk", """SELECT query_id, id, distance, rank FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::int AS rank FROM
  (SELECT q.vec_id AS query_id, c.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def _(t):
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.top_k(queries, t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


@query("embedding_cost", "SELECT event_id, round(event_id * CASE event_type WHEN 'click' THEN 0.02 WHEN 'view' THEN 0.13 ELSE 0 END / 1000.0, 6)::double AS cost FROM events")
def _(t):
    cost = scalars.embedding_cost(F.col("event_id"), F.col("event_type"), {"click": "0.02", "view": "0.13"})
    return t.events.select("event_id", cost.cast("double").alias("cost"))


@query("clamps_and_backoff", "SELECT event_id, CASE WHEN value/100 BETWEEN 0 AND 1 THEN value/100 ELSE 0.7 END AS alpha, greatest(1.0, least(10.0, value)) AS top_k, 60 * power(2.0, event_id % 5) AS retry, least(300.0, 10 * power(2.0, event_id % 7)) AS breaker FROM events")
def _(t):
    v, i = F.col("value"), F.col("event_id")
    return t.events.select("event_id", scalars.fraction_or(v / 100, 0.7).alias("alpha"), scalars.clamp(v, 1.0, 10.0, 5.0).alias("top_k"), scalars.retry_seconds(i % 5 + 1).alias("retry"), scalars.breaker_seconds(i % 7 + 1, 10.0, 300.0).alias("breaker"))


@query("freshness", "SELECT o_orderkey, least(25.0, greatest(0.0, 2.0 * (date_diff('day', o_orderdate::date, DATE '1998-12-31') - 1095) / 30.0)) AS penalty, CASE WHEN o_orderkey % 2 = 0 THEN 365 ELSE 1095 END AS cutoff FROM orders")
def _(t):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate"))
    mode = F.when(F.col("o_orderkey") % 2 == 0, "standard").otherwise("software_docs_strict")
    return t.orders.select("o_orderkey", scalars.freshness_penalty(age).alias("penalty"), scalars.freshness_days(mode).alias("cutoff"))


@query("next_alert_run", "SELECT o_orderkey, o_orderdate::timestamp + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 1 HOUR WHEN 1 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END AS next_run FROM orders")
def _(t):
    f = F.element_at(F.array(F.lit("hourly"), F.lit("daily"), F.lit("weekly")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", scalars.next_run(F.col("o_orderdate").cast("timestamp"), f).cast("timestamp_ntz").alias("next_run"))


@query("tolerant_times", "SELECT event_id, floor(epoch(ts))::bigint AS seconds FROM events")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    return t.events.select("event_id", F.unix_timestamp(scalars.tolerant_timestamp(text)).alias("seconds"))


@query("map_merge", "SELECT event_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM events")
def _(t):
    old = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("state"), F.lit("old"), F.lit("gone"), F.lit("x"))
    new = F.create_map(F.lit("state"), F.when(F.col("event_id") % 2 == 0, "new"))
    m = scalars.merge_maps(old, new, ["gone"])
    return t.events.select("event_id", F.try_element_at(m, F.lit("kind")).alias("kind"), F.try_element_at(m, F.lit("state")).alias("state"))


@query("weight_normalise", "SELECT event_id, CASE WHEN greatest(a,0)+greatest(b,0) > 0 THEN round(greatest(a,0)/(greatest(a,0)+greatest(b,0)), 9) END AS a FROM (SELECT event_id, value - 20 AS a, 10.0::double AS b FROM events)")
def _(t):
    w = scalars.normalised_weights(F.create_map(F.lit("a"), F.col("value") - 20, F.lit("b"), F.lit(10.0)))
    return t.events.select("event_id", F.round(F.coalesce(F.try_element_at(w, F.lit("a")), F.lit(0.0)), 9).alias("a"))


@query("embedded_json", "SELECT event_id, props AS body FROM events")
def _(t):
    return t.events.select("event_id", scalars.embedded_json(F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))).alias("body"))


@query("token_set_similarity", r"SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 9) AS cosine FROM (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1) WHERE len(a) > 0 AND len(b) > 0")
def _(t):
    from ..functions.text import dedup_tokens

    c = t.conversations
    d = c.select("conv_id", (F.col("turn") - 1).alias("turn"), dedup_tokens(F.col("text")).alias("b"))
    both = c.select("conv_id", "turn", dedup_tokens(F.col("text")).alias("a")).join(d, ["conv_id", "turn"]).where("size(a) > 0 AND size(b) > 0")
    return both.select("conv_id", "turn", F.round(vectors.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(vectors.set_cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query("provider_records", f"""SELECT page_id, 'web' AS provider, c AS canonical_source, CASE WHEN length('web::' || c) <= 60 THEN 'web::' || c ELSE 'web::' || sha1(c) END AS external_id, h AS host, 'https' AS scheme FROM
 (SELECT page_id, {HOST} AS h, CASE page_id % 4 WHEN 0 THEN NULL ELSE 'https://' || CASE WHEN page_id % 4 = 3 THEN 'xn--bcher-kva.' ELSE '' END || {HOST} || CASE WHEN page_id % 2 = 0 THEN ':8443' ELSE '' END || '/p/' || page_id % 7 || '/r' || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END || '?A=' || page_id || '&a=+x&b=2' END AS c FROM pages) WHERE c IS NOT NULL
 UNION ALL SELECT page_id, 'web', NULL, NULL, '', 'ftp' FROM pages WHERE page_id % 4 = 0""")
def _(t):
    i = F.col("page_id")
    host = urls.host(F.col("url"))
    made = F.concat(
        F.lit(" HTTPS://me:pw@"), F.when(i % 4 == 3, "Bücher.").otherwise(""), F.upper(host), F.when(i % 2 == 0, ":8443").otherwise(":443"), F.lit("/p//"), i % 7, F.lit("/./q/../r"), F.when(i % 3 == 0, "/").otherwise(""),
        F.lit("?b=2&A="), i, F.lit("&utm_x=1&fbclid=2&a=%20x#part"),
    )
    url = F.when(i % 4 == 0, F.lit("ftp:///none")).otherwise(made)
    r = t.pages.select("page_id", urls.provider_record(F.lit(" Web "), url, 60).alias("r"), host.alias("h"))
    return r.select("page_id", "r.provider", "r.canonical_source", "r.external_id", F.when(i % 4 == 3, F.replace(F.col("r.tags")["host"], F.lit("bücher."), F.lit(""))).otherwise(F.col("r.tags")["host"]).alias("host"), F.col("r.tags")["scheme"].alias("scheme"))
