"""Lookups around retrieval: versions, parents, cached vectors, scope, saved searches, retries and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Parents that make up a table of contents.
STRUCTURAL = ["heading", "section", "article", "document"]
# Attempts of a delivery, seconds before the second one, deliveries a run.
ATTEMPTS, BACKOFF, DELIVERIES = 5, 60, 100
# Saved searches a run, matches a search.
SEARCHES, MATCHES = 25, 50


def of_version(chunks: DataFrame, wanted: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Chunks (tenant, document, version, ord, ...) of wanted versions: of each a page by ord, with its place from 1."""
    key = ["tenant", "document", "version"]
    out = chunks.join(wanted.select(*key).distinct(), key, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("ord")))
    return out.where((F.col("place") > offset) & (F.col("place") <= (offset + limit if limit is not None else F.col("place"))))


def parent_context(documents: DataFrame, requests: DataFrame, cap: int = 0) -> DataFrame:
    """tenant_id, document, parent_id, content, content_bytes, truncated of the requested parents that are there.

    documents: tenant_id, document, parents (map of id to content). requests: tenant_id, document, parent_id (trimmed;
    blank ones ask for nothing); a document of another tenant isn't there. Contents of over cap bytes are cut at a character; a cap of 0 cuts none.
    """
    asked = requests.select("tenant_id", "document", F.trim("parent_id").alias("parent_id")).where("parent_id <> ''").distinct()
    held = documents.select("tenant_id", "document", F.explode("parents").alias("parent_id", "whole"))  # only ids and contents that are asked for leave the join
    size = F.octet_length("whole")
    over = (size > cap) & F.lit(cap > 0)
    content = F.when(over, tx.truncate_bytes(F.col("whole"), cap)).otherwise(F.col("whole")) if cap > 0 else F.col("whole")
    return held.join(asked, ["tenant_id", "document", "parent_id"]).select("tenant_id", "document", "parent_id", content.alias("content"), size.alias("content_bytes"), over.alias("truncated"))


def cache_get(cache: DataFrame, wanted: DataFrame, model: str, now: Column) -> DataFrame:
    """text_hash, embedding, created_at of the wanted hashes that the cache holds for a model and that aren't expired."""
    asked = wanted.select("text_hash").where("text_hash <> ''").distinct()
    live = cache.where((F.col("model_version") == model) & (F.col("expires_at") > now) & F.col("embedding").isNotNull())
    return live.join(asked, "text_hash", "left_semi").select("text_hash", "embedding", "created_at")


def cache_put(cache: DataFrame, rows: DataFrame, model: str, created: Column, ttl_days: int = 90) -> DataFrame:
    """The cache with rows (text_hash, embedding) of a model over those of the same hash and model."""
    new = rows.select("text_hash", F.lit(model).alias("model_version"), "embedding", created.alias("created_at"))
    new = new.withColumn("expires_at", F.col("created_at") + F.expr(f"INTERVAL {ttl_days} DAYS"))
    key = ["text_hash", "model_version"]
    return cache.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def scope_reasons(tenant: Column, case: Column, asked_tenant: Column, asked_case: Column) -> Column:
    """Why a retrieved candidate is out of the asked tenant and case; empty: it may be shown. Null asks for nothing,
    but a case without a tenant is never met."""
    one = lambda name, has, want: F.when(want.isNotNull() & has.isNull(), name + "_missing").when(has != want, name + "_mismatch")
    found = F.array_compact(F.array(one("tenant", tenant, asked_tenant), one("case", case, asked_case)))
    return F.when((F.size(found) == 0) & asked_case.isNotNull() & asked_tenant.isNull(), F.array(F.lit("unknown"))).otherwise(found)


def recheck_scope(candidates: DataFrame) -> DataFrame:
    """The candidates (tenant, case, asked_tenant, asked_case, ...) that a strict second look leaves."""
    return candidates.where(F.size(scope_reasons(*map(F.col, ("tenant", "case", "asked_tenant", "asked_case")))) == 0)


def contents_table(chunks: DataFrame) -> DataFrame:
    """document, position, id, title, kind, level: distinct structural parents by level and order, then as they come.

    chunks: document, ord, parents (array of structs id, title, kind, level, order). A parent's first mention counts.
    """
    p = chunks.select("document", "ord", F.posexplode("parents").alias("at", "p")).where(F.col("p.kind").isin(STRUCTURAL) & (F.col("p.id") != ""))
    first = p.groupBy("document", F.col("p.id").alias("id")).agg(F.min_by(F.struct("p.title", "p.kind", "p.level", "p.order", "ord", "at"), F.struct("ord", "at")).alias("f"))
    flat = first.select("document", "id", "f.*").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("order", F.coalesce("order", F.lit(0)))
    return flat.select("document", F.row_number().over(Window.partitionBy("document").orderBy("level", "order", "ord", "at")).alias("position"), "id", "title", "kind", "level")


def search_alerts(searches: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """search_id, document, rank: what is new for each saved search that is due, oldest first, at most MATCHES.

    searches: search_id, enabled, next_run, last_run, query, case_id, source, workflow_id, collection_id (null or
    blank: any). documents: document, title, external_id, updated_at, case_id, source, workflow_id, collection_id
    (one row a membership). A run takes SEARCHES at most, so these are broadcast.
    """
    due = searches.where(F.col("enabled") & (F.col("next_run") <= now)).orderBy("next_run", "search_id").limit(SEARCHES)
    s, d = due.alias("s"), documents.alias("d")
    on = F.col("s.last_run").isNull() | (F.col("d.updated_at") > F.col("s.last_run"))
    for name in ("case_id", "source", "workflow_id", "collection_id"):
        on = on & ((F.coalesce(f"s.{name}", F.lit("")) == "") | (F.col(f"s.{name}") == F.col(f"d.{name}")))
    has = lambda column: F.coalesce(F.contains(F.lower(column), F.lower("s.query")), F.lit(False))
    on = on & ((F.coalesce("s.query", F.lit("")) == "") | has("d.title") | has("d.external_id"))
    hits = d.join(F.broadcast(s), on).select("s.search_id", "d.document", "d.updated_at").distinct()
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy("updated_at", "document"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= MATCHES).select("search_id", "document", "rank")


def deliveries(pending: DataFrame, now: Column) -> DataFrame:
    """id, status, attempts, next_attempt after one run over pending deliveries (id, status, attempts, next_attempt, address, sent).

    The DELIVERIES oldest that are due are tried: without an address they are skipped; those not sent wait twice as
    long after each attempt and fail at the last one.
    """
    due = pending.where((F.col("status") == "pending") & (F.col("next_attempt") <= now)).orderBy("next_attempt", "id").limit(DELIVERIES)
    tried = F.col("attempts") + 1
    known = F.coalesce("address", F.lit("")) != ""
    status = F.when(~known, "skipped").when(F.col("sent"), "sent").when(tried >= ATTEMPTS, "failed").otherwise("pending")
    out = due.select("id", status.alias("status"), F.when(known, tried).otherwise(F.col("attempts")).cast("int").alias("attempts"), "next_attempt")
    return out.withColumn("next_attempt", F.when(F.col("status") == "pending", now + F.make_interval(secs=F.lit(BACKOFF) * F.pow(F.lit(2), F.col("attempts") - 1))).otherwise(F.col("next_attempt")))


def sweep(letters: DataFrame, now: Column, ttl_seconds: int, most: int = 1000, alert: int = 10) -> DataFrame:
    """queue, scanned, removed, kept, alert of dead letters (queue, ord, at): the `most` first of a queue are looked
    at and go once expired; alert: more than `alert` letters are left in the whole queue."""
    w = Window.partitionBy("queue").orderBy("ord")
    seen = letters.withColumn("scan", F.row_number().over(w) <= most)
    gone = F.col("scan") & (F.unix_micros(now) - F.unix_micros("at") > ttl_seconds * 1_000_000)
    out = seen.groupBy("queue").agg(F.count("*").alias("n"), F.count_if("scan").alias("scanned"), F.count_if(gone).alias("removed"))
    return out.select("queue", "scanned", "removed", (F.col("scanned") - F.col("removed")).alias("kept"), (F.col("n") - F.col("removed") > alert).alias("alert"))
