"""Upserts, versions, deletions and state replay, as table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(new: DataFrame, stored: DataFrame) -> DataFrame:
    """key, status (new, unchanged, changed), version: by the last stored hash (key, hash, version)."""
    last = stored.groupBy("key").agg(F.max_by(F.struct("hash", "version"), "version").alias("s"))
    j = new.join(last, "key", "left")
    status = F.when(F.col("s").isNull(), "new").when(F.col("s.hash") == F.col("hash"), "unchanged").otherwise("changed")
    return j.select("key", status.alias("status"), (F.coalesce("s.version", F.lit(0)) + (status != "unchanged").cast("int")).alias("version"))


def upsert_decisions(new: DataFrame, stored: DataFrame, near: DataFrame) -> DataFrame:
    """key, action of new rows (key, hash) against stored ones and near duplicates (key, other, replaces).

    inserted, skipped (same hash), replaced (other hash), linked (hash under another key),
    near_duplicate_skipped, or near_duplicate_replaced where the near duplicate of least key is to be replaced.
    """
    own = stored.select("key", F.col("hash").alias("old"))
    held = stored.groupBy("hash").agg(F.min("key").alias("holder"))
    j = new.join(own, "key", "left").join(held, "hash", "left").join(near.groupBy("key").agg(F.min(F.struct("other", "replaces")).alias("near")), "key", "left")
    action = F.when(F.col("old") == F.col("hash"), "skipped").when(F.col("old").isNotNull(), "replaced").when(F.col("holder").isNotNull(), "linked").when(F.col("near.replaces"), "near_duplicate_replaced").when(F.col("near").isNotNull(), "near_duplicate_skipped").otherwise("inserted")
    return j.select("key", action.alias("action"))


def replace_version(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """chunks (document, version, ord, text, is_latest) with a document's incoming version: the same one goes, others are superseded."""
    docs = incoming.select("document", F.col("version").alias("_v")).distinct()
    kept = chunks.join(docs, "document", "left").where(F.col("_v").isNull() | (F.col("version") != F.col("_v")))
    kept = kept.withColumn("is_latest", F.when(F.col("_v").isNotNull(), F.lit(False)).otherwise(F.col("is_latest"))).drop("_v")
    return kept.unionByName(incoming.withColumn("is_latest", F.lit(True)))


def set_state(table: DataFrame, chosen: DataFrame, key: str, state: str) -> DataFrame:
    """The table with a lifecycle state of the chosen keys."""
    marked = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(marked, key, "left").withColumn("lifecycle", F.when(F.col("_hit"), state).otherwise(F.col("lifecycle"))).drop("_hit")


def hard_delete(documents: DataFrame, chunks: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, counts) without the chosen documents."""
    gone = chosen.select(key).distinct()
    counts = documents.join(gone, key, "left_semi").agg(F.count("*").alias("documents")).crossJoin(chunks.join(gone, key, "left_semi").agg(F.count("*").alias("chunks")))
    return documents.join(gone, key, "left_anti"), chunks.join(gone, key, "left_anti"), counts


def drop_collection(documents: DataFrame, chunks: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of a collection go; its documents lose it."""
    mine = F.coalesce(F.col("collection_id") == collection, F.lit(False))
    return documents.withColumn("collection_id", F.when(~mine, F.col("collection_id"))), chunks.where(~mine)


def add_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table lacks are added, one for each key."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def merge_duplicates(collections: DataFrame, members: DataFrame, key: str, id_: str, created: Column) -> tuple[DataFrame, DataFrame]:
    """Of collections with one key the oldest stays; memberships of the others move to it."""
    w = Window.partitionBy(key).orderBy(created, id_)
    kept = collections.withColumn("_keep", F.first(id_).over(w))
    moved = members.join(kept.select(id_, "_keep"), id_).drop(id_).withColumnRenamed("_keep", id_).distinct()
    return kept.where(F.col(id_) == F.col("_keep")).drop("_keep"), moved


def purge(versions: DataFrame, deleted_at: str, now: Column, days: int = 30) -> DataFrame:
    """Versions deleted more than `days` ago go."""
    return versions.where(F.col(deleted_at).isNull() | (F.col(deleted_at) >= now - F.make_interval(days=F.lit(days))))


def replay(events: DataFrame, key: str, order: list[str], transitions: list[tuple[str, str | None, str]], start: str, last: int = 250) -> DataFrame:
    """key, phase: a fold of each key's last events in order over (event, from or any, to) transitions.

    At most `last` events of a key are kept in one row.
    """
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    recent = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, "event_type"))), lambda s: s["event_type"])

    def step(phase, event):
        out = None
        for kind, source, target in transitions:
            hit = (event == kind) & (F.lit(True) if source is None else phase == source)
            out = F.when(hit, target) if out is None else out.when(hit, target)
        return out.otherwise(phase)

    return recent.groupBy(key).agg(F.aggregate(seq, F.lit(start), step).alias("phase"))


def run_states(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last valid state of an ingestion run: queued, running, completed, in this order only."""
    level = F.when(F.col("state") == "queued", 0).when(F.col("state") == "running", 1).when(F.col("state").isin("completed", "failed"), 2)
    best = F.max(level).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    ok = events.withColumn("_level", level).withColumn("_best", best).where(F.col("_best").isNull() | (F.col("_level") > F.col("_best")))
    return ok.groupBy(key).agg(F.max_by("state", F.struct("_level", at)).alias("state"))


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    marked = rows.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def changed_fields(columns: list[str], old: str = "old", new: str = "new") -> Column:
    """Names of the fields that differ between two structs."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), c) for c in columns]))
