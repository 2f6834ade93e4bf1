"""Resolution of not-modified revisits in web archives, in DataFrame functions only.

A revisit record (status 304) gets the latest earlier full response (status 200) of its
canonical URL. If both have an entity tag, the tags must agree (weakly); otherwise, if the
revisit has a Last-Modified date, it must be the response's. A resolved record has the
response's payload and headers, with the header fields that a 304 may update.

The as-of join is a running maximum in two levels: inside slices of time (cut at quantiles) of each URL, and over
the last responses of a URL's slices, of which there are at most `slices`; so the records of
one very frequent URL are spread over tasks. Payloads stay out of both.

Defined results: records without a URL or time resolve to nothing ("no response"); of
responses at one time the largest record_id counts; a response at the revisit's own time
isn't earlier; repeated records repeat; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Header fields that a 304 doesn't update.
KEPT_OF_RESPONSE = [
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "etag", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
# Query parameters that don't name a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: scheme, www., default port, fragment, tracking and a last slash go; parameters are sorted."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_before(events: DataFrame, slices: int = 64) -> DataFrame:
    """events: url, at (long), is_response, id, response (a struct; null if it isn't one).

    The rows that aren't responses, with `found`: the latest earlier response of their url.
    """
    cuts = events.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)] or [0.5], 10_000)).first()[0] or []
    events = events.withColumn("slice", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>"), lambda c: c < F.col("at"))))
    order = [F.col("at"), F.col("is_response"), F.col("id")]
    inside = F.last("response", ignorenulls=True).over(Window.partitionBy("url", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = events.withColumn("inside", inside).where(~F.col("is_response")).drop("response")
    ends = events.groupBy("url", "slice").agg(F.max_by("response", F.when(F.col("is_response"), F.struct("at", "id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("before", before).select("url", "slice", "before")
    return asked.join(ends, ["url", "slice"], "left").withColumn("found", F.coalesce("inside", "before")).drop("inside", "before", "slice")


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, at (long), status, etag, last_modified, digest, headers (map of lower-case names).

    record_id, canonical_url, outcome (resolved, no response, validator mismatch), and for a
    resolved revisit response_id, digest and the merged headers.
    """
    r = records.where(F.col("status").isin(200, 304)).select("record_id", canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"), "status", "etag", "last_modified", "digest", "headers")
    whole = F.col("url").isNotNull() & F.col("at").isNotNull()
    response = F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "digest", "headers")
    events = r.where(whole).select("url", "at", (F.col("status") == 200).alias("is_response"), F.col("record_id").alias("id"), F.when(F.col("status") == 200, response).alias("response"), "etag", "last_modified", "headers")
    found = latest_before(events).unionByName(r.where(~whole & (F.col("status") == 304)).select("url", "at", F.lit(False).alias("is_response"), F.col("record_id").alias("id"), "etag", "last_modified", "headers"), allowMissingColumns=True)
    f = F.col("found")
    tags = F.col("etag").isNotNull() & f["etag"].isNotNull()
    agree = F.when(tags, weak(F.col("etag")) == weak(f["etag"])).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == f["last_modified"], F.lit(False))).otherwise(True)
    outcome = F.when(f.isNull(), "no response").when(agree, "resolved").otherwise("validator mismatch")
    new = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(KEPT_OF_RESPONSE))
    old = F.map_filter(F.coalesce(f["headers"], F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k))
    done = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        F.col("id").alias("record_id"), F.col("url").alias("canonical_url"), "outcome", F.when(done, f["id"]).alias("response_id"),
        F.when(done, f["digest"]).alias("digest"), F.when(done, F.map_concat(old, new)).alias("headers"),
    )


def with_payloads(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """The resolved revisits with their responses' payloads."""
    return resolved.join(records.select(F.col("record_id").alias("response_id"), payload), "response_id", "left")


def crawl(pages: DataFrame, later: int = 3) -> DataFrame:
    """Archive records of the page table: each page's full response, and a revisit of it `later` pages on.

    Pages have entity tags, but every third a date only.
    """
    dated = F.col("page_id") % 3 == 0
    tag = F.when(~dated, F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')))
    date = F.when(dated, F.concat(F.lit("day "), (F.length("html") % 28).cast("string")))
    base = pages.select("page_id", "url", tag.alias("etag"), date.alias("last_modified"), F.md5("html").alias("digest"), F.length("html").cast("string").alias("n"))
    text = lambda c: F.col(c).cast("string")
    response = base.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("at"), F.lit(200).alias("status"), "etag", "last_modified", "digest", F.create_map(F.lit("content-length"), F.col("n"), F.lit("date"), text("page_id"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    revisit = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", ((F.col("page_id") + later) * 2 + 1).alias("at"), F.lit(304).alias("status"), F.concat(F.lit("W/"), F.col("etag")).alias("etag"), "last_modified", F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + later).cast("string")).alias("headers"))
    return response.unionByName(revisit)


def revisits(pages: DataFrame) -> DataFrame:
    """record_id, canonical_url, outcome, response_id, digest, date, content_length, cache_control."""
    header = lambda k: F.try_element_at("headers", F.lit(k))
    return resolve(crawl(pages)).select("record_id", "canonical_url", "outcome", "response_id", "digest", header("date").alias("date"), header("content-length").alias("content_length"), header("cache-control").alias("cache_control"))


SQL = r"""
WITH base AS (
  SELECT page_id, md5(html) AS digest, length(html) AS n,
         CASE WHEN page_id % 3 <> 0 THEN '"' || substr(md5(html), 1, 16) || '"' END AS etag,
         CASE WHEN page_id % 3 = 0 THEN 'day ' || (length(html) % 28) END AS last_modified,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query
  FROM pages),
named AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS u FROM base),
asked AS (
  SELECT r.page_id, r.u, r.etag, r.last_modified, max(p.page_id) AS found
  FROM named r LEFT JOIN named p ON p.u = r.u AND p.page_id * 2 < (r.page_id + 3) * 2 + 1
  GROUP BY ALL),
judged AS (
  SELECT a.page_id, a.u, p.page_id AS pid, p.digest, p.n,
         CASE WHEN p.page_id IS NULL THEN 'no response'
              WHEN CASE WHEN a.etag IS NOT NULL AND p.etag IS NOT NULL THEN a.etag = p.etag
                        WHEN a.last_modified IS NOT NULL THEN coalesce(a.last_modified = p.last_modified, false)
                        ELSE true END THEN 'resolved'
              ELSE 'validator mismatch' END AS outcome
  FROM asked a LEFT JOIN named p ON p.page_id = a.found)
SELECT page_id * 2 + 1 AS record_id, u AS canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN pid * 2 END AS response_id,
       CASE WHEN outcome = 'resolved' THEN digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN CAST(page_id + 3 AS VARCHAR) END AS date,
       CASE WHEN outcome = 'resolved' THEN CAST(n AS VARCHAR) END AS content_length,
       CASE WHEN outcome = 'resolved' THEN 'max-age=60' END AS cache_control
FROM judged
"""
