"""What is there and what is missing: prefixes, facets, summaries of matches, recommendations, drift, evaluation cases, requests to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .merging import given
from .scoped import identifier

FACETS = list(tx.FACET_KEYWORDS)


def prefix_summary(chunks: DataFrame, by: str, sample: int = 3, most: int = 160) -> DataFrame:
    """chunk_count, with_prefix, missing_prefix, coverage_ratio, mean and longest prefix, and the first prefixes. chunks: by, n, prefix."""
    p = chunks.select(by, "n", given(F.col("prefix")).alias("p"))
    p = p.withColumn("k", F.when(F.col("p").isNotNull(), F.row_number().over(Window.partitionBy(by).orderBy(F.col("p").isNull(), "n"))))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= sample, F.struct("k", F.substring("p", 1, most).alias("p")))))
    got = p.groupBy(by).agg(F.count("*").alias("chunk_count"), F.count("p").alias("with_prefix"), F.coalesce(F.avg(F.length("p")), F.lit(0.0)).alias("mean_prefix_length"), F.coalesce(F.max(F.length("p")), F.lit(0)).alias("max_prefix_length"), F.transform(first, lambda s: s["p"]).alias("samples"))
    return got.withColumns({"missing_prefix": F.col("chunk_count") - F.col("with_prefix"), "coverage_ratio": F.round(F.col("with_prefix") / F.col("chunk_count"), 6), "mean_prefix_length": F.round("mean_prefix_length", 6)})


def facet_rows(texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep, facet, position and score: a row for each facet of a text."""
    scores = F.array(*[F.struct(F.lit(name).alias("facet"), F.lit(i).alias("position"), c.alias("score")) for i, (name, c) in enumerate(tx.facets(F.col(text)).items())])
    return texts.select(*keep, F.explode(scores).alias("f")).select(*keep, "f.*")


def facet_means(texts: DataFrame, by: str) -> DataFrame:
    """by, facet, mean: how far the corpus covers each facet."""
    return facet_rows(texts, by).groupBy(by, "facet").agg(F.avg("score").alias("mean"))


def improvements(items: DataFrame, means: DataFrame, least: float = 0.2, gap: float = 0.4) -> DataFrame:
    """query_id, id, rank, facet, position: what an item covers that the corpus doesn't. items: query_id, id, rank, text; means: query_id, facet, mean."""
    has = facet_rows(items, "query_id", "id", "rank").where(F.col("score") >= least)
    return has.join(means, ["query_id", "facet"], "left").where(F.coalesce("mean", F.lit(0.0)) < gap).select("query_id", "id", "rank", "facet", "position")


def coverage_delta(items: DataFrame, means: DataFrame) -> DataFrame:
    """query_id, delta: a sentence on the facets that a query's items add, in the order of the items."""
    first = improvements(items, means).groupBy("query_id", "facet").agg(F.min(F.struct("rank", "position")).alias("at"))
    named = first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "facet"))), lambda s: s["facet"]), ", ").alias("names"))
    said = F.when(F.col("names").isNotNull(), F.concat(F.lit("Adds coverage across: "), "names")).otherwise("Hybrid ranking maintains existing coverage")
    return items.select("query_id").distinct().join(named, "query_id", "left").select("query_id", said.alias("delta"))


def recommended(items: DataFrame, means: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, id, rank, reason of items whose candidate is trusted and no PDF. candidates: id, trust, is_pdf."""
    tags = improvements(items, means).groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "facet"))), lambda s: s["facet"]), ", ").alias("tags"))
    known = items.select("query_id", "id", "rank").join(candidates.where(F.col("trust").isin("high", "medium") & ~F.coalesce("is_pdf", F.lit(False))).select("id"), "id")
    reason = F.when(F.col("tags").isNotNull(), F.concat(F.lit("Addresses gaps: "), "tags")).otherwise("High relevance candidate")
    return known.join(tags, ["query_id", "id"], "left").select("query_id", "id", "rank", reason.alias("reason"))


def match_summaries(matches: DataFrame, pool: int = 200) -> DataFrame:
    """query_id, key, title, url, combined text, key points and facets of each document that a query's matches are of.

    matches: query_id, n (their order), document_id, id, hash, source, title, citation,
    source_url, text; the first `pool` of a query count. Documents without text are left out.
    """
    key = F.coalesce(given(F.col("document_id")), given(F.col("id")), given(F.col("hash")), given(F.col("source")), F.lit("unknown"))
    first = matches.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("_k") <= pool).withColumn("key", key)
    one = first.groupBy("query_id", "key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "\n").alias("combined"),
        F.min_by(F.struct(F.coalesce(given(F.col("title")), given(F.col("citation")), F.lit("RAG Document")).alias("title"), F.coalesce(given(F.col("source_url")), given(F.col("source"))).alias("url")), "n").alias("head"), F.count("*").alias("matches"),
    )
    out = one.where(F.btrim("combined", F.lit(" \t\n\x0b\x0c\r")) != "")
    return out.select("query_id", "key", "head.title", "head.url", "matches", "combined", tx.key_points(F.col("combined")).alias("key_points"), *[c.alias(n.lower()) for n, c in tx.facets(F.col("combined")).items()])


def eval_cases(events: DataFrame, most: int = 5000) -> DataFrame:
    """query_text, case_id, collection_id, workflow_id, thread_id and the relevant ids of each, from the newest `most` uses of a source.

    events: created_at, event_id, query_text, chunk_id, source_id, source_label and the four ids; blanks are nulls.
    """
    parts = ["query_text", "case_id", "collection_id", "workflow_id", "thread_id"]
    newest = events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(most)
    cleaned = newest.select(*[given(F.col(c)).alias(c) for c in parts], F.coalesce(*[given(F.col(c)) for c in ("chunk_id", "source_id", "source_label")]).alias("relevant"))
    return cleaned.where("query_text is not null and relevant is not null").groupBy(*parts).agg(F.array_sort(F.collect_set("relevant")).alias("relevant_ids"))


def drift_recall(expected: DataFrame, found: DataFrame, before: DataFrame, alert: float = -0.1) -> DataFrame:
    """tenant_id, recall, hits, total, delta, alert: the share of a tenant's queries of which an expected id is found.

    expected (query_id, tenant_id, query, chunk_ids, document_ids): chunks count if there are any,
    else documents; queries without a text, a tenant or an id are skipped. found (query_id,
    chunk_id, document_id); before (tenant_id, recall).
    """
    cleaned = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    e = expected.select("query_id", given(F.col("tenant_id")).alias("tenant_id"), given(F.col("query")).alias("query"), cleaned("chunk_ids").alias("c"), cleaned("document_ids").alias("d"))
    e = e.where("tenant_id is not null and query is not null").withColumn("by_chunk", F.size("c") > 0).withColumn("ids", F.when(F.col("by_chunk"), F.col("c")).otherwise(F.col("d"))).where(F.size("ids") > 0)
    want = e.select("query_id", "tenant_id", "by_chunk", F.explode("ids").alias("wanted"))
    got = found.select(F.col("query_id").alias("q"), F.explode(F.array(F.struct(F.lit(True).alias("k"), F.col("chunk_id").alias("v")), F.struct(F.lit(False).alias("k"), F.col("document_id").alias("v")))).alias("x")).where("x.v is not null").select("q", "x.k", "x.v").distinct()
    hit = want.join(got, (F.col("query_id") == F.col("q")) & (F.col("by_chunk") == F.col("k")) & (F.col("wanted") == F.col("v"))).select("query_id").distinct().withColumn("hit", F.lit(1))
    per = e.select("query_id", "tenant_id").join(hit, "query_id", "left").groupBy("tenant_id").agg(F.count("hit").alias("hits"), F.count("*").alias("total"))
    recall = F.round(F.col("hits") / F.col("total"), 6)
    out = per.select("tenant_id", recall.alias("recall"), "hits", "total").join(before.select("tenant_id", F.col("recall").alias("_b")), "tenant_id", "left")
    delta = F.round(F.col("recall") - F.col("_b"), 6)
    return out.select("tenant_id", "recall", "hits", "total", delta.alias("delta"), F.coalesce(delta <= alert, F.lit(False)).alias("alert"))


def next_sequences(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """document, label, sequence, label_sequence of incoming versions (document, label), one for each document: after the greatest there are."""
    last = versions.groupBy("document").agg(F.max("sequence").alias("s"))
    label = versions.groupBy("document", "label").agg(F.max("label_sequence").alias("l")).select(F.col("document").alias("d"), F.col("label").alias("b"), "l")
    joined = incoming.join(last, "document", "left").join(label, (F.col("document") == F.col("d")) & F.col("label").eqNullSafe(F.col("b")), "left")
    return joined.select("document", "label", (F.coalesce("s", F.lit(0)) + 1).alias("sequence"), (F.coalesce("l", F.lit(0)) + 1).alias("label_sequence"))


def appended_history(history: DataFrame, new: DataFrame, limit: int = 6) -> DataFrame:
    """conv_id, turn, role, content: both tables' messages, the last `limit` of a conversation; messages without a role or a text, and new ones that are empty, go."""
    usable = history.where("role is not null and content is not null").select("conv_id", "turn", "role", "content")
    both = usable.unionByName(new.where("role is not null and content != ''").select("conv_id", "turn", "role", "content"))
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    return both.withColumn("_k", back).where(F.col("_k") <= limit).drop("_k") if limit > 0 else both


def delete_requests(requests: DataFrame, users: DataFrame, admins: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """request_id, status, operator, mode, deleted_ids, not_found: who may delete what, and what there is.

    requests: request_id, tenant_id, reason, ticket_ref, user_id, internal_key, label,
    document_ids; users: user_id, name, active, role; admins: user_id of organisations;
    documents: document_id, tenant_id. status is deleted, or what is missing.
    """
    u = users.select("user_id", F.col("name").alias("_name"), F.col("active").alias("_active"), F.col("role").alias("_role"))
    a = admins.select("user_id").distinct().withColumn("_org", F.lit(True))
    r = requests.join(u, "user_id", "left").join(a, "user_id", "left")
    key = F.coalesce(F.col("internal_key").isin(keys), F.lit(False))
    known = F.col("_active").isNotNull()
    status = (
        F.when(given(F.col("tenant_id")).isNull(), "tenant_id").when(given(F.col("reason")).isNull(), "reason").when(given(F.col("ticket_ref")).isNull(), "ticket_ref").when(key, "deleted").when(F.col("user_id").isNull(), "actor")
        .when(~known, "unknown_user").when(~F.col("_active"), "inactive").when((F.col("_role") == "TENANT_ADMIN") | F.coalesce("_org", F.lit(False)), "deleted").otherwise("no_admin")
    )
    mode = F.when(key, "service_key").when(F.col("_role") == "TENANT_ADMIN", "user_admin").otherwise("org_admin")
    ids = F.array_distinct(F.array_compact(F.transform(F.coalesce("document_ids", F.array().cast("array<string>")), identifier)))
    r = r.select("request_id", "tenant_id", status.alias("status"), F.when(status == "deleted", F.coalesce(given(F.col("label")), F.when(key, F.col("internal_key")).otherwise(F.col("_name")))).alias("operator"), F.when(status == "deleted", mode).alias("mode"), F.when(status == "deleted", ids).alias("ids"))
    there = r.select("request_id", "tenant_id", F.explode("ids").alias("document_id")).join(documents.select("document_id", "tenant_id"), ["document_id", "tenant_id"], "left_semi")
    found = there.groupBy("request_id").agg(F.array_sort(F.collect_list("document_id")).alias("deleted_ids"))
    none = F.array().cast("array<string>")
    return r.join(found, "request_id", "left").select("request_id", "status", "operator", "mode", F.coalesce("deleted_ids", none).alias("deleted_ids"), F.when(F.col("status") == "deleted", F.size("ids") - F.size(F.coalesce("deleted_ids", none))).alias("not_found"))


def contract_errors(tenant: Column, workflow: Column, title: Column, tags: Column, language: Column, media_type: Column, bbox: Column) -> Column:
    """What breaks a document's contract, by the names of its errors; parts that are null are optional but for the tenant and the media type."""
    named = lambda c, most, prefix: [F.when(c.isNull(), f"{prefix}_empty"), F.when(F.length(c) > most, f"{prefix}_too_long")]
    w, tag = given(workflow), lambda x: F.trim(x)
    box = F.size(bbox) != 4
    for i in range(4):
        box = box | ~((F.get(bbox, F.lit(i)) >= 0) & (F.get(bbox, F.lit(i)) <= 1))
    box = box | (F.get(bbox, F.lit(2)) <= F.get(bbox, F.lit(0))) | (F.get(bbox, F.lit(3)) <= F.get(bbox, F.lit(1)))
    media = F.lower(F.trim(F.substring_index(given(media_type), ";", 1)))
    return F.array_compact(F.array(
        *named(given(tenant), 128, "tenant"), F.when(F.length(w) > 128, "workflow_too_long").when(~w.rlike("^[A-Za-z0-9._-]+$"), "workflow_invalid_char"), F.when(F.length(given(title)) > 256, "title_too_long"),
        F.when(F.exists(tags, lambda x: F.length(tag(x)) > 64), "tag_too_long"), F.when(F.exists(tags, lambda x: (tag(x) != "") & (F.length(tag(x)) <= 64) & ~tag(x).rlike("^[A-Za-z0-9._-]+$")), "tag_invalid"),
        F.when(language.isNotNull() & ~(language.rlike("^[A-Za-z0-9]{1,8}(-[A-Za-z0-9]{1,8})*$") & language.rlike("[A-Za-z]")), "language_invalid"),
        F.when(given(media_type).isNull(), "media_type_empty").when(~media.rlike("^[A-Za-z0-9_.+-]+/[A-Za-z0-9_.+-]+$"), "media_type_invalid"), F.when(bbox.isNotNull() & F.coalesce(box, F.lit(True)), "bbox_invalid"),
    ))


def parse_statistics(documents: DataFrame, blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """document and its statistics: blocks, assets, and assets of each media type. blocks: document; assets: document, media_type."""
    n = blocks.groupBy("document").agg(F.count("*").alias("b"))
    kinds = assets.groupBy("document", "media_type").agg(F.count("*").alias("k"))
    named = F.struct(F.concat(F.lit("parse.assets.media_type."), F.replace("media_type", F.lit("/"), F.lit("_"))).alias("key"), F.col("k").alias("value"))
    per = kinds.groupBy("document").agg(F.sum("k").alias("a"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce("media_type", F.lit("")) != "", named)))).alias("m"))
    total = F.create_map(F.lit("parse.blocks.total"), F.coalesce("b", F.lit(0)), F.lit("parse.assets.total"), F.coalesce("a", F.lit(0)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return documents.select("document").join(n, "document", "left").join(per, "document", "left").select("document", F.map_concat(total, F.coalesce("m", none)).alias("statistics"))
