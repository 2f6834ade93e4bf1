"""Equal matches and chunks as one: keys, the winner's fields, and metadata merged key by key.

What belongs to one key is never gathered: maps are taken apart into entries, of which each
group keeps one for each name, so that a key with very many rows is aggregated before it is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoped import identifier

MAP = "map<string,string>"


def given(c: Column) -> Column:
    """Trimmed; null if that leaves nothing."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def match_key(chunk_id: Column, hash_: Column, id_: Column, text: Column, n: Column) -> Column:
    """Key of a match: its chunk, else its hash, else its id and text, else its id and place, else its place alone."""
    sep = F.lit("\x1f")
    with_text = F.concat(F.lit("it"), sep, given(id_), sep, F.sha2(text, 256))
    return F.coalesce(F.concat(F.lit("c"), sep, given(chunk_id)), F.concat(F.lit("h"), sep, given(hash_)), with_text, F.concat(F.lit("in"), sep, given(id_), sep, n.cast("string")), F.concat(F.lit("n"), sep, n.cast("string")))


def merged_maps(rows: DataFrame, by: list[str], column: str, order: str, last: bool = False) -> DataFrame:
    """by and the maps of a group as one: of a name that several have, the first value (or the last) in their order."""
    each = rows.select(*by, order, F.explode(column).alias("_k", "_v"))
    pick = F.max_by if last else F.min_by
    one = each.groupBy(*by, "_k").agg(pick(F.struct("_v"), order).alias("_s"))  # a struct, for a null value is a value
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", F.col("_s._v").alias("_v"))))).alias(column))


def merged_matches(matches: DataFrame) -> DataFrame:
    """One match of each query and key: the first of the highest score, with the metadata of all that have this score.

    matches: query_id, n (their order), chunk_id, hash, id, text, score, meta (a map). Of a name
    in several maps the first value counts. rank: by score, then id as text.
    """
    keyed = matches.withColumn("key", match_key(F.col("chunk_id"), F.col("hash"), F.col("id"), F.col("text"), F.col("n")))
    best = keyed.groupBy("query_id", "key").agg(F.max("score").alias("_best"))
    top = keyed.join(best, ["query_id", "key"]).where(F.col("score") == F.col("_best"))
    first = top.groupBy("query_id", "key").agg(F.min_by(F.struct("id", "text", "score"), "n").alias("w"))
    out = first.join(merged_maps(top, ["query_id", "key"], "meta", "n"), ["query_id", "key"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(F.col("id").cast("string"), F.lit("")), "key"))
    return out.select("query_id", "key", "w.*", F.coalesce("meta", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("meta")).withColumn("rank", place)


# Metadata of a chunk that isn't its document's.
OWN = ["tenant_id", "tenant", "hash", "source", "doc_class"]
KEY = ["tenant_id", "workflow_id", "external_id", "collection_id"]


def document_key(meta) -> dict[str, Column]:
    """The four parts of a chunk's document, from its metadata; a hash stands in for an external id, a class for a collection."""
    named = lambda c: F.when(given(meta(c)) != "None", given(meta(c)))
    collection = F.coalesce(named("collection_id"), named("doc_class"))
    return {"tenant_id": F.coalesce(named("tenant_id"), named("tenant")), "workflow_id": named("workflow_id"), "external_id": F.coalesce(named("external_id"), named("hash")), "collection_id": F.coalesce(identifier(collection), collection)}


def grouped_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) of chunks (n: their order, meta: a map, parents: a map).

    documents: the four parts of the key, document_id
    (null if it names no valid one), hash, source and metadata of the first chunk, parents of all (of one name the last),
    chunks, and other_ids: chunks that name another valid document_id. refused: n and reason
    of chunks without a tenant or a hash.
    """
    meta = lambda c: F.col("meta")[c]
    parts = document_key(meta)
    known = F.when(given(meta("hash")) != "None", given(meta("hash")))
    rows = chunks.select("n", "meta", "parents", *[c.alias(k) for k, c in parts.items()], known.alias("hash"), F.coalesce(given(meta("source")), F.lit("unknown")).alias("source"), identifier(meta("document_id")).alias("document_id"))
    refused = rows.where("tenant_id is null or hash is null").select("n", F.when(F.col("tenant_id").isNull(), "tenant_id").otherwise("hash").alias("reason"))
    rows = rows.where("tenant_id is not null and hash is not null")
    safe = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(f"_{c}") for c in KEY]
    rows = rows.select("*", *safe)
    by = [f"_{c}" for c in KEY]
    own = F.map_filter("meta", lambda k, v: ~k.isin(OWN))
    one = rows.groupBy(*by).agg(
        F.min_by(F.struct(*KEY, "hash", "source", own.alias("metadata")), "n").alias("d"), F.min_by(F.struct("document_id"), "n").alias("_first"), F.count("*").alias("chunks"),
    )
    ids = rows.where("document_id is not null").groupBy(*by, "document_id").agg(F.count("*").alias("k")).withColumnRenamed("document_id", "_named")
    other = one.select(*by, F.col("_first.document_id").alias("document_id")).join(ids, by).where(~F.col("_named").eqNullSafe(F.col("document_id"))).groupBy(*by).agg(F.sum("k").alias("other_ids"))
    out = one.join(merged_maps(rows, by, "parents", "n", last=True), by, "left").join(other, by, "left")
    return out.select("d.*", F.col("_first.document_id").alias("document_id"), "parents", "chunks", F.coalesce("other_ids", F.lit(0)).alias("other_ids")), refused
