"""Documents, chunks and vectors that are written together: decisions, versions, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.stages import cut
from ..sources.commits import Change, Claims, Commit, Tables
from . import lifecycle as lc

KEYS = {"documents": "key", "chunks": "chunk_id", "embeddings": "chunk_id"}
SKIPPED = ["skipped", "near_duplicate_skipped"]


def store(spark, path: str) -> Tables:
    """documents (key, hash, ...), chunks (chunk_id, key, version, is_latest, ...), embeddings (chunk_id, v)."""
    return Tables(spark, path, KEYS)


def refused(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, tenant: str, dimension: int | None = None) -> DataFrame:
    """chunk_id, reason of rows that a task may not write: another tenant's, of no document that comes with it, or with a
    vector of another length or without one number that counts."""
    foreign = chunks.where(F.col("tenant_id").isNotNull() & (F.col("tenant_id") != tenant)).select("chunk_id", F.lit("tenant").alias("reason"))
    lost = chunks.join(documents.select("key"), "key", "left_anti").select("chunk_id", F.lit("document").alias("reason"))
    size = F.size("v") != (dimension if dimension is not None else F.size("v"))
    bad = embeddings.where("v is not null").where(size | (vectors.squared(F.col("v")) <= vectors.ZERO)).select("chunk_id", F.lit("vector").alias("reason"))
    return foreign.unionByName(lost).unionByName(bad)


def changes(tables: Tables, seen: list[Commit], documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, near: DataFrame | None = None) -> tuple[dict[str, Change], DataFrame]:
    """What an upsert changes, and (key, action, chunks) of each document that comes.

    documents: key, hash and more, one row for each key; chunks with a version replace that
    version of their document, and its others are no longer the latest; chunks without one
    replace all its chunks. near: key, other, replaces.
    """
    spark = tables.spark
    if near is None:
        near = spark.createDataFrame([], f"key {dict(documents.dtypes)['key']}, other {dict(documents.dtypes)['key']}, replaces boolean")
    stored, held, vectors_ = (tables.table(n, seen) for n in ("documents", "chunks", "embeddings"))
    old = stored.select("key", "hash") if stored is not None else documents.select("key", "hash").limit(0)
    decided = lc.upsert_decisions(documents.select("key", "hash"), old.join(documents.select("key"), "key", "left_semi").unionByName(old.join(documents.select("hash"), "hash", "left_semi").select("key", "hash")).distinct(), near)
    decided = cut(decided)
    acting = decided.where(~F.col("action").isin(SKIPPED))
    victims = acting.where("action = 'near_duplicate_replaced'").join(near.where("replaces").groupBy("key").agg(F.min("other").alias("other")), "key").select(F.col("other").alias("key"))
    touched = acting.select("key").unionByName(victims).distinct()
    new_chunks = chunks.join(acting.select("key"), "key", "left_semi")
    touched = cut(touched)
    out = {"documents": Change(documents.join(acting.select("key"), "key", "left_semi"), touched)}
    if held is None:
        out |= {"chunks": Change(new_chunks), "embeddings": Change(embeddings.join(new_chunks.select("chunk_id"), "chunk_id", "left_semi"))}
    else:
        versions = new_chunks.where("version is not null").select("key", F.col("version").alias("_version")).distinct()
        mine = cut(held.join(touched, "key", "left_semi").join(versions, "key", "left"))
        stays = F.col("_version").isNotNull() & ~F.col("version").eqNullSafe(F.col("_version"))
        aged = mine.where(stays).drop("_version").withColumn("is_latest", F.lit(False))
        going = mine.where(~stays).select("chunk_id")
        out["chunks"] = Change(new_chunks.unionByName(aged, allowMissingColumns=True), mine.select("chunk_id").unionByName(new_chunks.select("chunk_id")).distinct())
        own = embeddings.join(new_chunks.select("chunk_id"), "chunk_id", "left_semi")
        out["embeddings"] = Change(own, going.unionByName(own.select("chunk_id")).distinct() if vectors_ is not None else None)
    return out, decided.join(new_chunks.groupBy("key").agg(F.count("*").alias("chunks")), "key", "left").fillna(0, ["chunks"])


def upsert(tables: Tables, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, near: DataFrame | None = None, tries: int = 3, wait: float = 0.05) -> dict[str, int]:
    """Write documents with their chunks and vectors in one commit; how many documents met which action, and chunks written.

    Of rows with one key the greatest hash counts, of chunks and vectors with one id one row.
    """
    documents = documents.withColumn("_r", F.row_number().over(_first("key", "hash"))).where("_r = 1").drop("_r")
    chunks, embeddings = chunks.dropDuplicates(["chunk_id"]), embeddings.dropDuplicates(["chunk_id"])
    counts: dict[str, int] = {}

    def change(seen: list[Commit]):
        made, actions = changes(tables, seen, documents, chunks, embeddings, near)
        counts.clear()
        for r in actions.groupBy("action").agg(F.count("*").alias("n"), F.sum("chunks").alias("chunks")).collect():
            counts[r.action] = r.n
            counts["chunks"] = counts.get("chunks", 0) + r.chunks
        return (made, {"actions": dict(counts)}) if set(counts) - {*SKIPPED, "chunks"} else None

    tables.transact(change, tries, wait)
    return counts


def _first(key: str, by: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.desc(by))


def idempotency_key(*parts: str | None) -> str:
    """Of tenant, vector space, content hash and embedding profile."""
    import hashlib

    return hashlib.sha256("\x1f".join("" if p is None else p for p in parts).encode()).hexdigest()


def upsert_task(tables: Tables, claims: Claims, key: str, tenant: str, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, dimension: int | None = None) -> dict[str, int]:
    """An upsert that a key allows once: rows are checked first, a done key writes nothing, one at work raises InFlight."""

    def work() -> dict[str, int]:
        bad = refused(documents, chunks, embeddings, tenant, dimension).first()
        if bad is not None:
            raise ValueError(f"chunk {bad.chunk_id}: {bad.reason}")
        return upsert(tables, documents, chunks, embeddings)

    return claims.once(key, work, {"chunks": 0})
