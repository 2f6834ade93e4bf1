"""Hybrid search within a scope: typed filters, a scope for each query, a trigram leg with a limit and a fallback."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scored
from ..functions import text as tx
from ..functions import vectors
from ..functions.stages import cut
from . import search as se

#: The metadata keys that a filter may name, and the chunk columns they are held against.
METADATA = {"source": "source", "doctype": "doctype", "published": "published", "document_version_id": "document_version_id", "id": "document_id", "external_id": "external_id"}
#: Scope columns of a query; null means that it isn't asked for.
ASKED = ["tenant_id", "case_id", "collection_ids", "visibility", "is_latest", "hash", *METADATA]
#: Most tenants that are written into a scan's filter.
LISTED = 1000


def _text(value: object) -> str | None:
    return (str(value).strip() or None) if value is not None else None


@dataclass(frozen=True)
class FilterSpec:
    """Filters of a retrieval request. Blanks are no filter; unknown keys are metadata."""

    tenant_id: str | None = None
    case_id: str | None = None
    collection_id: str | None = None
    collection_ids: tuple[str, ...] | None = None
    document_id: str | None = None
    document_version_id: str | None = None
    is_latest: bool | None = None
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict | None = None, **scope: str | None) -> FilterSpec:
        """From raw filters and the scope of the request; a raw value wins over the scope's."""
        raw = dict(raw or {})
        known = {f.name for f in fields(cls)} - {"metadata"}
        values = {k: _text(raw.get(k)) or scope.get(k) for k in known - {"collection_ids", "is_latest"}}
        ids = raw.get("collection_ids")
        ids = [ids] if isinstance(ids, str) else ids or []
        metadata = (raw.get("metadata") or {}) | {k: v for k, v in raw.items() if k not in known | {"metadata"}}
        return cls(**values, collection_ids=tuple(t for t in map(_text, ids) if t) or None, is_latest=raw.get("is_latest"), metadata=metadata)

    def mapping(self) -> dict:
        """What a store is asked with: no tenant, no case, no nulls; metadata doesn't override typed filters."""
        typed = {"collection_id": self.collection_id, "collection_ids": self.collection_ids, "document_id": self.document_id, "document_version_id": self.document_version_id, "is_latest": self.is_latest}
        return {k: v for k, v in (self.metadata | typed).items() if v is not None}

    def predicate(self, visibility: str = "active", routing: bool = False) -> Column:
        """The same as one condition on chunk columns, in comparisons that a Parquet scan takes over."""
        return in_scope(self.scope(visibility), F.col, routing)

    def scope(self, visibility: str = "active") -> dict:
        """Values of the scope columns of a query."""
        found = self.mapping()
        ids = found.get("collection_ids") or ([found["collection_id"]] if found.get("collection_id") else None)
        latest = found.get("is_latest")
        latest = str(latest).strip().lower() or None if latest is not None else None
        if latest is None and not found.get("document_version_id"):
            latest = "true"
        meta = {k: found.get(k) for k in (*METADATA, "hash")}
        return {"tenant_id": self.tenant_id, "case_id": self.case_id, "collection_ids": list(ids) if ids else None, "visibility": visibility, "is_latest": latest} | {k: str(v) if _text(v) else None for k, v in meta.items()}


def in_scope(asked: dict, held, routing: bool = False) -> Column:
    """Whether a chunk is in a scope. asked: by name of ASKED, values that hold for all rows or columns of a query,
    of which a null asks for nothing; held(name) gives the chunk's column.

    Case and collections are a union. With `routing`, a document class that is named as a
    collection counts as one.
    """
    given = {k: v for k, v in asked.items() if v is not None}
    out: list[Column] = []

    def asks(name: str, test) -> None:
        if name in given:
            v = given[name]
            out.append(v.isNull() | test(v) if isinstance(v, Column) else test(F.lit(v)))

    active = (held("lifecycle").isNull() | (held("lifecycle") == "active")) & (held("lifecycle_state").isNull() | (held("lifecycle_state") == "active"))
    shown = given.get("visibility", "active")
    if isinstance(shown, Column):
        out.append(F.when(shown == "all", True).when(shown == "deleted", ~active).otherwise(active))
    elif shown != "all":
        out.append(~active if shown == "deleted" else active)
    asks("tenant_id", lambda v: held("tenant_id") == v)
    asks("is_latest", lambda v: (held("is_latest") == v) | ((v == "true") & held("is_latest").isNull()))
    asks("hash", lambda v: (held("hash") == v) | (held("metadata_hash") == v))
    for name, column in METADATA.items():
        asks(name, lambda v, column=column: held(column) == v)
    arms, nothing = [], F.lit(True)
    for name, columns in (("case_id", ["case_id"]), ("collection_ids", ["collection_id", *["doc_class"] * routing])):
        if name in given:
            v = given[name]
            one_of = (lambda c, v=v: F.array_contains(v, held(c))) if isinstance(v, Column) else (lambda c, v=v: held(c).isin(v))
            tests = [held(c) == v for c in columns] if name == "case_id" else [one_of(c) for c in columns]
            arms += [F.coalesce(t, F.lit(False)) for t in tests] if isinstance(v, Column) else tests
            nothing = nothing & v.isNull() if isinstance(v, Column) else F.lit(False)
    if arms:
        any_arm = arms[0]
        for t in arms[1:]:
            any_arm = any_arm | t
        out.append(nothing | any_arm if any(isinstance(given.get(n), Column) for n in ("case_id", "collection_ids")) else any_arm)
    total = out[0] if out else F.lit(True)
    for c in out[1:]:
        total = total & c
    return total


def routed(requests: DataFrame, allowed: Column) -> DataFrame:
    """A router's preparation of requests: text is trimmed, blanks are null; collections are one list of valid identifiers,
    the routed one first, then those asked for, then the single filter; what is shown is guarded.

    requests: visibility, collection_id (of the route), filter_collection, filter_collections
    (array), doc_class, filter_doc_class, workflow_id. allowed: whether the request may see more
    than active rows. Adds collection_ids (null if none), collection, doc_class, visibility.
    """
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    single, route = identifier(F.col("filter_collection")), text(F.col("collection_id"))
    listed = F.array_compact(F.transform(F.coalesce("filter_collections", F.array().cast("array<string>")), identifier))
    asked = F.array_distinct(F.concat(listed, F.array_compact(F.array(single))))
    ids = F.when(route.isNotNull() & ~F.array_contains(asked, route), F.concat(F.array(route), asked)).otherwise(asked)
    shown = F.lower(F.trim("visibility"))
    return requests.select(
        "*", F.when(F.size(ids) > 0, ids).alias("collection_ids_asked"), F.coalesce(route, single).alias("collection_asked"),
        F.coalesce(text(F.col("filter_doc_class")), text(F.col("doc_class"))).alias("doc_class_asked"),
        F.when(shown.isin("all", "deleted") & allowed, shown).otherwise("active").alias("visibility_shown"),
    )


def identifier(c: Column) -> Column:
    """A UUID in its usual form, whatever form it is given in; null if it is none."""
    digits = F.replace(F.btrim(F.replace(F.replace(F.lower(F.trim(c)), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), F.lit("{}")), F.lit("-"), F.lit(""))
    parts = [F.substring(digits, lo, n) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def validated(requests: DataFrame, normalize: bool = False, cap: int = 200, top_k: int = 5) -> DataFrame:
    """A router's checks of requests (tenant_id, top_k, max_candidates, visibility and collection_id as text).

    error: the first that applies of collection, tenant, top_k, max_candidates, their relation
    and visibility; null for a good request, which has effective_top_k, effective_max_candidates
    and where they come from. With `normalize`, too few candidates are raised to top_k.
    """
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    whole = lambda c: F.when(given(c).rlike("^[+-]?[0-9]{1,9}$"), given(c).cast("int"))
    bad = lambda c: given(c).isNotNull() & ~F.coalesce(whole(c) > 0, F.lit(False))
    k = F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(whole(F.col("top_k")), F.lit(top_k))))
    most = whole(F.col("max_candidates"))
    shown = F.lower(F.trim("visibility"))
    few = most < k
    error = (
        F.when(given(F.col("collection_id")).isNotNull() & identifier(F.col("collection_id")).isNull(), "ROUTER_COLLECTION_ID_INVALID").when(given(F.col("tenant_id")).isNull(), "ROUTER_TENANT_REQUIRED").when(bad(F.col("top_k")), "ROUTER_TOP_K_INVALID")
        .when(bad(F.col("max_candidates")), "ROUTER_MAX_CANDIDATES_INVALID").when(F.lit(not normalize) & few, "ROUTER_MAX_CANDIDATES_LT_TOP_K").when(F.coalesce(shown, F.lit("")).isin("", "active", "deleted", "all"), None).otherwise("ROUTER_VISIBILITY_INVALID")
    )
    source = lambda c: F.when(given(c).isNull(), "from_default").otherwise("from_state")
    pool = F.when(most.isNull(), F.greatest(k, F.lit(cap))).otherwise(F.least(F.lit(cap), F.greatest(most, k)))
    out = requests.withColumn("error", error)
    good = F.col("error").isNull()
    return out.select("*", *[F.when(good, c).alias(n) for n, c in (("effective_top_k", k), ("top_k_source", source(F.col("top_k"))), ("effective_max_candidates", F.least(F.lit(cap), pool)), ("max_candidates_source", source(F.col("max_candidates"))))])


# -- the two legs --------------------------------------------------------------------------------
def prepared(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with all scope columns, named q_...; and the chunks that some query can see.

    What all queries share goes into the scan of the chunks: the tenants, if they are counted to
    be at most LISTED, and active rows only, if nothing else is asked for.
    """
    for c in ASKED:
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit("active") if c == "visibility" else F.lit("true") if c == "is_latest" and "document_version_id" not in queries.columns else F.lit(None).cast("array<string>" if c == "collection_ids" else "string"))
    for c in ("lifecycle", "lifecycle_state", "is_latest", "hash", "metadata_hash", "case_id", "collection_id", "doc_class", *METADATA.values()):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    tenants = [r[0] for r in queries.select("tenant_id").distinct().limit(LISTED + 1).collect()]
    if len(tenants) <= LISTED and None not in tenants:
        chunks = chunks.where(F.col("tenant_id").isin(tenants))
    if queries.where("visibility in ('all', 'deleted')").isEmpty():
        chunks = chunks.where(in_scope({}, F.col))
    return queries.select([F.col(c).alias(f"q_{c}") if c in ASKED else F.col(c) for c in queries.columns]), chunks


def seen(routing: bool = False, deleted: bool = False) -> Column:
    """The scope of a prepared query against a chunk beside it; with `deleted`, whatever its state."""
    asked = {c: F.col(f"q_{c}") for c in ASKED} | ({"visibility": "all"} if deleted else {})
    return in_scope(asked, F.col, routing)


SCOPED = ["tenant_id", "lifecycle", "lifecycle_state", "is_latest", "hash", "metadata_hash", "case_id", "collection_id", "doc_class", *METADATA.values()]


#: Most combinations of a chunk's scope columns that are broadcast.
COMBINATIONS = 50_000


def sighted(queries: DataFrame, chunks: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """Queries with `no` and the number of their scope; and the chunks that some query sees, with `seen`, the scopes that see them.

    Scopes are held against the combinations of scope columns that occur, not against chunks.
    """
    asks = [c for c in queries.columns if c.startswith("q_")]
    scopes = cut(queries.select(*asks).distinct().withColumn("scope", F.monotonically_increasing_id()))
    numbered = queries.withColumn("asks", F.struct(*asks)).join(scopes.select(F.struct(*asks).alias("asks"), "scope"), "asks").drop("asks")
    numbered = cut(numbered.select("*", F.monotonically_increasing_id().alias("no"), F.col("q_tenant_id").alias("grp")))
    combined = chunks.select(*SCOPED).distinct().join(scopes, (F.col("tenant_id") == F.col("q_tenant_id")) & scope)
    combined = cut(combined.groupBy(F.struct(*SCOPED).alias("held")).agg(F.collect_list("scope").alias("seen")))
    few = combined.count() <= COMBINATIONS
    return numbered, chunks.withColumn("held", F.struct(*SCOPED)).join(F.broadcast(combined) if few else combined, "held").withColumn("grp", F.col("tenant_id"))


def named(found: DataFrame, numbered: DataFrame) -> DataFrame:
    """query_id for the number."""
    return found.join(numbered.select("no", "query_id"), "no").drop("no")


def vector_leg(queries: DataFrame, chunks: DataFrame, limit: int, scope: Column) -> DataFrame:
    """query_id, id, distance, rank: the nearest chunks of a query's scope. Queries without a usable vector have no rows."""
    usable = chunks.select("id", *SCOPED, vectors.unit(F.col("v")).alias("unit")).where("unit is not null")
    q, c = sighted(queries.withColumn("unit", vectors.unit(F.col("v"))).where("unit is not null"), usable, scope)
    near = named(scored.by_vectors(q.select("no", "grp", "scope", "unit"), c, limit), q)
    return se.ranked(near.select("query_id", "id", F.col("cost").alias("distance")), "query_id", "distance", "id", most=limit)


def word_leg(queries: DataFrame, chunks: DataFrame, limit: int, scope: Column) -> DataFrame:
    """query_id, id, lscore, rank: a tenth of the occurrences of any query word in the chunks of its scope."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(tx.WORD), F.lit(0))
    q, c = sighted(queries, chunks.select("id", "text", *SCOPED), scope)
    asked = q.select("no", "grp", "scope", F.array_distinct(words(F.col("q"))).alias("terms"), F.lit(0.0).alias("at_least")).where("size(terms) > 0")
    found = named(scored.by_terms(asked, c.select("id", "grp", "seen", words(F.col("text")).alias("terms")), limit, False), q)
    return se.ranked(found.select("query_id", "id", F.round(F.col("cost") * -0.1, 6).alias("lscore")), "query_id", F.desc("lscore"), "id", most=limit)


def similar(queries: DataFrame, chunks: DataFrame, scope: Column, most: int | None = None) -> DataFrame:
    """query_id, id, similarity of the chunks of a query's scope that are similar by trigrams to its limit at least.

    queries: query_id, q, at_least and scope columns. With `most`, of each query the most similar so many
    at least, ties by id, and perhaps some more; else all. Chunks that share no trigram have no row.
    """
    spark = chunks.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q, c = sighted(queries, chunks.select("id", "text", *SCOPED).repartition(parts, "id"), scope)
    asked = q.select("no", "grp", "scope", tx.trigrams(F.col("q")).alias("terms"), "at_least").where("size(terms) > 0")
    found = named(scored.by_terms(asked, c.select("id", "grp", "seen", tx.trigrams(F.col("text")).alias("terms")), most, True), q)
    return found.select("query_id", "id", (-F.col("cost")).alias("similarity"))


def limits(requested: float | None, limit: float) -> tuple[list[float], float]:
    """The limits that are tried in turn where nothing reaches the first, and the floor at which a match ends the search."""
    low = min(limit, se.LADDER[0])
    tried = [*([requested] if requested is not None else []), low, *se.LADDER[1:]]
    return list(dict.fromkeys(max(0.0, x) for x in tried)), max(0.0, requested) if requested is not None else min(limit, 0.05)


def trigram_leg(queries: DataFrame, chunks: DataFrame, most: int, scope: Column, requested: float | None = None, limit: float = 0.3) -> DataFrame:
    """query_id, id, lscore, rank, fallback_limit: chunks at the limit or, for queries without any, at a lower one.

    The second leg runs only if there are such queries, and only for them. Its similarities give
    the limit: of the limits tried, the first at or under the floor that some chunk reaches. At
    zero every chunk of the scope matches: those that share no trigram come last, by id.
    """
    first = cut(similar(queries.withColumn("at_least", F.lit(min(1.0, max(0.0, requested if requested is not None else limit)))), chunks, scope, most))
    found = first.withColumn("fallback_limit", F.lit(None).cast("double"))
    rest = queries.where(F.trim("q") != "").join(first.select("query_id").distinct(), "query_id", "left_anti")
    if not rest.isEmpty():
        tried, floor = limits(requested, limit)
        wide = cut(similar(rest.withColumn("at_least", F.lit(0.0)), chunks, scope, most))
        best = wide.groupBy("query_id").agg(F.max("similarity").alias("best"), F.count("*").alias("n"))
        used = F.lit(0.0)
        for x in reversed([x for x in tried if x <= floor + 1e-9]):
            used = F.when(F.col("best") >= x, x).otherwise(used)
        picked = cut(rest.select("query_id").join(best, "query_id", "left").select("query_id", used.alias("fallback_limit"), F.coalesce("n", F.lit(0)).alias("n")))
        second = wide.join(picked.drop("n"), "query_id").where("similarity >= fallback_limit").select("query_id", "id", "similarity", "fallback_limit")
        found = found.unionByName(second)
        short = picked.where((F.col("fallback_limit") == 0) & (F.col("n") < most)).drop("n")  # all that is similar to them was found
        if not short.isEmpty():
            scopes = rest.select("query_id", *[c for c in rest.columns if c.startswith("q_")]).join(short, "query_id")
            none = chunks.select("id", *SCOPED).join(scopes, (F.col("tenant_id") == F.col("q_tenant_id")) & scope).select("query_id", "id", "fallback_limit")
            unlike = none.join(wide.select("query_id", "id"), ["query_id", "id"], "left_anti")
            unlike = se.ranked(unlike, "query_id", "id", most=most).select("query_id", "id", F.lit(0.0).alias("similarity"), "fallback_limit")
            found = found.unionByName(unlike)
    return se.ranked(found.withColumnRenamed("similarity", "lscore"), "query_id", F.desc("lscore"), "id", most=most)


@dataclass
class Search:
    """hits: query_id, id, vrank, lrank, fused, rank, cutoff_fallback. report: one row a query, with all counts and limits; None if it wasn't asked for."""

    hits: DataFrame
    report: DataFrame | None


def hybrid_search(queries: DataFrame, chunks: DataFrame, params: se.HybridParams | None = None, mode: str = "bm25", requested: float | None = None, routing: bool = False, report: bool = True) -> Search:
    """queries (query_id, q, v and scope columns) against chunks (id, text, v, tenant_id and scope columns).

    Both legs see only what is in a query's scope, before they are cut to their limits. mode trgm
    searches by trigrams, with the fallback; its queries may fill up with hits under the cutoff.
    Without `report` the legs aren't run a second time for what the visibility filter holds back.
    """
    p = (params or se.HybridParams()).clamped()
    asked, held = prepared(queries, chunks)
    asked = cut(asked)

    def legs(scope: Column, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        vec = vector_leg(asked, chunks, p.vec_limit, scope)
        if mode == "trgm":
            return vec, trigram_leg(asked, chunks, p.lex_limit, scope, requested, p.trgm_limit)
        return vec, word_leg(asked, chunks, p.lex_limit, scope).withColumn("fallback_limit", F.lit(None).cast("double"))

    vec, lex = legs(seen(routing), held)
    vec, lex = cut(vec), cut(lex)
    fell = lex.groupBy("query_id").agg(F.count("*").alias("lexical_candidates"), F.max("fallback_limit").alias("fallback_limit_used"))
    together = cut(se.fused(vec, lex, p.alpha, p.rrf_k).join(fell.select("query_id", "fallback_limit_used"), "query_id", "left"))
    hits = se.cutoff(together, p.min_sim, p.top_k, promote=F.col("fallback_limit_used").isNotNull()).drop("fallback_limit_used")
    if not report:
        return Search(hits, None)

    _, unfiltered = prepared(queries.withColumn("visibility", F.lit("all")), chunks)
    any_vec, any_lex = legs(seen(routing, deleted=True), unfiltered)
    total = any_vec.select("query_id", "id").union(any_lex.select("query_id", "id")).distinct().groupBy("query_id").agg(F.count("*").alias("cached_total_candidates"))
    scored = together.groupBy("query_id").agg(F.count("*").alias("fused_candidates"), F.count_if(F.col("fused") < p.min_sim).alias("below_cutoff"))
    given = hits.groupBy("query_id").agg(F.count_if(~F.col("cutoff_fallback")).alias("returned_after_cutoff"), F.count("*").alias("returned"))
    told = asked.select("query_id", F.col("q_visibility").alias("visibility"), vectors.unit(F.col("v")).isNull().alias("query_embedding_empty"))
    for part in (vec.groupBy("query_id").agg(F.count("*").alias("vector_candidates")), fell, scored, given, total):
        told = told.join(part, "query_id", "left")
    counts = ["vector_candidates", "lexical_candidates", "fused_candidates", "below_cutoff", "returned_after_cutoff", "returned", "cached_total_candidates"]
    told = told.fillna(0, counts).withColumn("cached_total_candidates", F.when(F.col("visibility") == "active", F.col("cached_total_candidates")))
    blocked = F.greatest(F.lit(0), F.col("cached_total_candidates") - F.col("vector_candidates") - F.col("lexical_candidates"))
    constants = {"alpha": F.lit(p.alpha), "min_sim": F.lit(p.min_sim), "vec_limit": F.lit(p.vec_limit), "lex_limit": F.lit(p.lex_limit), "applied_trgm_limit": F.lit(p.trgm_limit if mode == "trgm" else None).cast("double"), "lexical_index_used": F.lit("trigram" if mode == "trgm" else "words")}
    return Search(hits, told.withColumns({"deleted_matches_blocked": F.coalesce(blocked, F.lit(0)), **constants}))
