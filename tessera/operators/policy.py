"""Predicates, guardrails, routing, crawl scheduling and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded
from ..functions.urls import host_suffixes


# -- scope and visibility --------------------------------------------------------------------
def scope(filters: dict, case_id: str | None = None, mode: str = "strict") -> Column:
    """A predicate for scope filters: blanks are no filter, collections are a set, the case argument wins.

    mode union keeps rows of the case or of the collections; strict asks for both. Unless a
    version or is_latest is asked for, rows that aren't marked as superseded are kept.
    """
    f = {k: v.strip() if isinstance(v, str) else v for k, v in filters.items()}
    f = {k: v for k, v in f.items() if v not in (None, "", [])}
    case = case_id or f.pop("case_id", None)
    f.pop("case_id", None)
    collections = list(dict.fromkeys(f.pop("collection_ids", []) or ([f.pop("collection_id")] if "collection_id" in f else [])))
    f.pop("collection_id", None)
    out = F.lit(True)
    in_case = F.col("case_id") == case if case else None
    in_collection = F.col("collection_id").isin(collections) if collections else None
    if in_case is not None and in_collection is not None:
        out = in_case | in_collection if mode == "union" else in_case & in_collection
    elif in_case is not None or in_collection is not None:
        out = in_case if in_case is not None else in_collection
    if "document_version_id" not in f and "is_latest" not in f:
        out = out & (F.coalesce(F.col("is_latest"), F.lit("true")) == "true")
    for k, v in f.items():
        out = out & (F.col(k) == v)
    return out


def visible(document_state: Column, chunk_state: Column, visibility: str = "active", override: bool = False) -> Column:
    """Active rows; deleted or all of them only with an override."""
    active = (F.coalesce(document_state, F.lit("active")) == "active") & (F.coalesce(chunk_state, F.lit("active")) == "active")
    if visibility == "all" and override:
        return F.lit(True)
    return ~active if visibility == "deleted" and override else active


def contains_all(blob: Column, query: Column) -> Column:
    """Every word of a query is a substring of a text."""
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(F.lower(blob), w))


def permitted(matches: DataFrame, accessible: DataFrame) -> DataFrame:
    """Matches (user_id, document_id) without a document, or with one that the user may see."""
    have = accessible.select("user_id", "document_id").distinct().withColumn("_ok", F.lit(True))
    return matches.join(have, ["user_id", "document_id"], "left").where(F.col("document_id").isNull() | F.col("_ok")).drop("_ok")


def case_access(account: Column, role: Column, is_member: Column, in_tenant_scope: Column) -> Column:
    """Whether a case is open to a user, by account kind and role."""
    return (
        F.when(account == "EXTERNAL", is_member)
        .when((account == "ENTERPRISE") & role.isin("TENANT_ADMIN", "LEGAL", "MANAGEMENT"), True)
        .when((account == "ENTERPRISE") & (role == "WORKS_COUNCIL"), in_tenant_scope)
        .when((account == "LAW_FIRM") & (role == "TENANT_ADMIN"), True)
        .otherwise(is_member)
    )


def is_active_account(account: Column, active: Column, expires: Column, now: Column) -> Column:
    return active & ~(F.coalesce((account == "EXTERNAL") & (now >= expires), F.lit(False)))


# -- guardrails -------------------------------------------------------------------------------
def guardrail(host: Column, mime: Column, size: Column, seconds: Column, tenant_docs: Column, tenant_bytes: Column, limits: dict) -> Column:
    """The first limit that fails, or allow. Quotas hold the usage with this document added."""
    out = F.when(host.isin(limits.get("host_blocklist", [""])), "host_blocklisted")
    out = out.when(mime.isin(limits.get("mime_blacklist", [""])), "mime_blacklisted")
    out = out.when(size > limits.get("max_document_bytes", 2**62), "document_too_large")
    out = out.when(seconds > limits.get("processing_time_limit", 1e18), "processing_time_exceeded")
    over = (tenant_docs + 1 > limits.get("max_documents", 2**62)) | (tenant_bytes + size > limits.get("max_bytes", 2**62))
    return out.when(over, "tenant_quota_exceeded").otherwise("allow")


def fetch_violations(size: Column, seconds: Column, mime: Column, limits: dict) -> Column:
    return F.array_compact(F.array(
        F.when(size > limits["max_bytes"], "max_bytes"), F.when(seconds > limits["timeout"], "timeout"), F.when(~mime.isin(limits["mime_whitelist"]), "mime_type"),
    ))


def fetch_status(violations: Column, status: Column, failure: Column) -> Column:
    """What a fetch came to, by its violations, HTTP status and failure."""
    return (
        F.when(F.size(violations) > 0, "policy_denied")
        .when(status.isNull(), F.when(failure == "permanent", "gone").otherwise("temporary_error"))
        .when(status == 304, "not_modified")
        .when(status.isin(404, 410), "gone")
        .when((status >= 200) & (status < 300), "fetched")
        .when(status.isin(401, 403, 451), "policy_denied")
        .when(status.isin(429, 500, 502, 503, 504), "temporary_error")
        .when(failure == "permanent", "gone")
        .otherwise("temporary_error")
    )


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """The longest matching prefix decides; at equal length the path is allowed."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: (r != "") & path.startswith(r)), F.length)), F.lit(-1))
    return ~(longest(disallow) > longest(allow))


def answer_guardrail(snippets: DataFrame, least: int = 1, score: float = 0.2) -> DataFrame:
    """query_id, verdict: enough snippets, then a top score that is high enough."""
    s = snippets.groupBy("query_id").agg(F.count("score").alias("n"), F.max("score").alias("top"))
    return s.select("query_id", F.when(F.col("n") < least, "too_few_snippets").when(F.coalesce("top", F.lit(0.0)) < score, "low_score").otherwise("ok").alias("verdict"))


def domain_policy(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, action, priority: rules (suffix, action, priority) by suffix; the highest priority, at a tie reject first.

    Rules are a small table of settings; hosts are exploded to their suffixes and joined.
    """
    h = hosts.select("host").distinct()
    hits = h.select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix")).join(rules, "suffix")
    best = hits.groupBy("host").agg(F.max_by(F.struct("action", "priority"), F.struct("priority", (F.col("action") == "reject").cast("int"), F.length("suffix"))).alias("r"))
    return h.join(best, "host", "left").select("host", F.coalesce("r.action", F.lit("neutral")).alias("action"), "r.priority")


# -- routing ---------------------------------------------------------------------------------
SELECTORS = ["collection_id", "workflow_id", "process", "doc_class", "tenant"]


def routed(items: DataFrame, rules: DataFrame, default: str, broadcast_rows: int = 10_000) -> DataFrame:
    """items (id and selectors) with the profile of the most specific rule; null selectors of rules match all.

    conflict: two equally specific rules name different profiles. Rules are settings, a few rows: up to
    `broadcast_rows` they are broadcast, else they meet the items in blocks.
    """
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in SELECTORS], "profile")
    cond = F.lit(True)
    for c in SELECTORS:
        cond = cond & (F.col(f"r_{c}").isNull() | (F.col(f"r_{c}") == F.col(c)))
    given = [F.col(f"r_{c}").isNotNull().cast("int") for c in SELECTORS]
    if r.count() <= broadcast_rows:
        met = items.join(F.broadcast(r), cond, "left")
    else:
        met = items.join(items.crossJoin(bounded(r, broadcast_rows)).where(cond).select("id", *r.columns), "id", "left")
    hit = met.withColumn("_p", F.struct(*given, sum(given, F.lit(0))))
    w = Window.partitionBy("id")
    top = hit.withColumn("_top", F.max(F.when(F.col("profile").isNotNull(), F.col("_p"))).over(w)).where(F.col("_top").isNull() | (F.col("_p") == F.col("_top")))
    return top.groupBy("id").agg(F.coalesce(F.min("profile"), F.lit(default)).alias("profile"), (F.countDistinct("profile") > 1).alias("conflict"))


# -- crawl frontier ---------------------------------------------------------------------------
def recrawl_seconds(frequency: Column, manual: Column, observed: Column, unchanged: Column, fresh: Column) -> Column:
    """Seconds to the next visit: hourly, daily or weekly, shortened by observed changes, lengthened while nothing changes."""
    base = F.when(frequency == "frequent", 3600.0).when(frequency == "infrequent", 7 * 86400.0).otherwise(86400.0)
    seen = F.least(base, F.when(observed > 0, observed).otherwise(base))
    longer = seen * F.when(unchanged > 0, 1 + F.least(F.lit(5), unchanged) * 0.5).otherwise(1.0)
    stale = longer * F.when(fresh > 0, F.least(F.lit(2.0), 1 + fresh / longer)).otherwise(1.0)
    return F.when(manual.isNotNull(), F.when(manual > 0, manual).otherwise(base)).otherwise(stale)


def frontier(retire: Column, failures: Column, allowed: Column, last: Column, interval: Column, delay: Column, host_ready: Column, now: Column) -> Column:
    """struct(action, reason, at) of a source; times are seconds. A later reason wins only if it is later in time."""
    steps = [
        (F.when(last.isNotNull(), last + interval), "recrawl_schedule"),
        (F.when(delay.isNotNull(), F.coalesce(last, now) + delay), "robots_crawl_delay"),
        (host_ready, "host_politeness"),
        (F.when(failures >= 3, now + F.least(60 * failures, F.lit(900))), "failure_backoff"),
    ]
    at, reason = now.cast("double"), F.lit("ready")
    for when, name in steps:
        later = F.coalesce(when > at, F.lit(False))
        at, reason = F.when(later, when.cast("double")).otherwise(at), F.when(later, name).otherwise(reason)
    stop = F.when(retire, "manual_retire").when(failures >= 5, "retire_after_failures").when(~allowed, "robots_disallow")
    action = F.when(retire | (failures >= 5), "retire").when(~allowed, "skip").when(at > now, "defer").otherwise("enqueue")
    return F.struct(action.alias("action"), F.coalesce(stop, reason).alias("reason"), F.when(stop.isNull(), at).alias("at"))


# -- lifecycle ----------------------------------------------------------------------------------
# State changes of stored documents.
TRANSITIONS = {"active": ["active", "retired", "deleted"], "retired": ["active", "retired", "deleted"], "deleted": ["deleted"]}


def transition_ok(before: Column, after: Column) -> Column:
    out = F.when(before.isNull(), True)
    for state, targets in TRANSITIONS.items():
        out = out.when(before == state, after.isin(targets))
    return out.otherwise(False)


def expired_letters(payload: Column, now: Column, ttl: float) -> Column:
    """Dead letters past their time; those whose time can't be read stay."""
    at = F.get_json_object(payload, "$.dead_lettered_at").try_cast("double")
    return F.coalesce(at < now - ttl, F.lit(False))


def contract_errors(title: Column, tags: Column, language: Column, media_type: Column) -> Column:
    """What breaks a document's contract."""
    return F.array_compact(F.array(
        F.when(F.length(title) > 256, "title"), F.when(F.size(F.array_distinct(tags)) > 64, "tags"),
        F.when(~language.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), "language"), F.when(~media_type.rlike("^[a-z0-9.+-]+/[a-z0-9.+-]+$"), "media_type"),
    ))
