"""Joins, aggregates, windows, pages and set operations over chunk and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- joins ---------------------------------------------------------------------------------
def scoped_chunks(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, scope: Column) -> DataFrame:
    """embeddings, chunks and documents along their keys, filtered by scope."""
    return chunks.join(documents, "document_id").where(scope).join(embeddings, "chunk_id")


def neighbours(chunks: DataFrame, targets: DataFrame, window: int = 1) -> DataFrame:
    """Chunks (document, ord, section, id) within `window` places of a target of the same document and section.

    An equi-join on document and offset place: each target asks for its 2 * window places.
    """
    offsets = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    asked = targets.select("document", F.col("section").alias("t_section"), F.col("id").alias("target"), "ord", F.explode(offsets).alias("by"))
    asked = asked.withColumn("ord", F.col("ord") + F.col("by")).drop("by")
    return chunks.join(asked, ["document", "ord"]).where(F.col("section").eqNullSafe(F.col("t_section"))).select("target", "document", "ord", "id")


def version_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, change: added, removed, changed or same, by identity and hash (id, hash)."""
    both = left.select("id", F.col("hash").alias("x")).join(right.select("id", F.col("hash").alias("y")), "id", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return both.select("id", change.alias("change"))


def existing_document(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new (id, external_id, source, hash): the stored document of its external id, else of source and hash unless external ids differ."""
    by_ext = stored.groupBy("external_id").agg(F.min("id").alias("e"))
    by_hash = stored.groupBy("source", "hash").agg(F.min_by(F.struct("id", "external_id"), "id").alias("h"))
    j = new.join(by_ext, "external_id", "left").join(by_hash, ["source", "hash"], "left")
    veto = F.col("h.external_id").isNotNull() & F.col("external_id").isNotNull() & (F.col("h.external_id") != F.col("external_id"))
    return j.select("id", F.coalesce("e", F.when(~veto, F.col("h.id"))).alias("found"), (F.col("e").isNull() & veto).alias("vetoed"))


def partition_ids(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each asked id and whether it is stored."""
    have = stored.select(key).distinct().withColumn("found", F.lit(True))
    return asked.select(key).distinct().join(have, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def pending(prepared: DataFrame, cached: DataFrame, key: str, alive: Column) -> DataFrame:
    """Prepared rows without a live cache entry."""
    return prepared.join(cached.where(alive).select(key), key, "left_anti")


# -- aggregates ----------------------------------------------------------------------------
def length_stats(chunks: DataFrame, by: list[str], n: Column) -> DataFrame:
    """Count, sum, extremes, mean, median, sample deviation and five buckets of lengths."""
    edges = [(0, 100), (100, 300), (300, 800), (800, 1500)]
    buckets = [F.count_if((n >= a) & (n < b)).alias(f"below_{b}") for a, b in edges] + [F.count_if(n >= 1500).alias("from_1500")]
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.sum(n.cast("long")).alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.median(n), 6).alias("median"), F.round(F.stddev_samp(n), 6).alias("deviation"), *buckets)


def summary(df: DataFrame, column: str) -> DataFrame:
    """label, n: rows by a column; null and empty count as unknown."""
    label = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("unknown"))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def exclusive(members: DataFrame, item: str, group: str) -> DataFrame:
    """Items that belong to one group only, and that group."""
    return members.groupBy(item).agg(F.countDistinct(group).alias("n"), F.min(group).alias(group)).where("n = 1").select(item, group)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, least, most, mean over rows, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), F.round(F.avg("x"), 6).alias("mean"))


def facet_gaps(df: DataFrame, by: list[str], facets: list[str], low: float = 0.4) -> DataFrame:
    """Mean of each facet and whether it is a gap."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("x")) for f in facets])).alias("s")).select(*by, "s.*")
    return long.groupBy(*by, "facet").agg(F.round(F.avg("x"), 6).alias("mean")).withColumn("gap", F.col("mean") < low)


def coverage(chunks: DataFrame, sources: DataFrame, key: str, threshold: float = 0.95) -> DataFrame:
    """Share of a source's characters that its chunks hold, 1 at most."""
    held = chunks.groupBy(key).agg(F.sum("n").alias("held"))
    j = sources.join(held, key, "left")
    share = F.least(F.lit(1.0), F.coalesce("held", F.lit(0)) / F.greatest(F.col("total"), F.lit(1)))
    return j.select(key, F.round(share, 6).alias("share"), (share >= threshold).alias("covered"))


# -- windows -------------------------------------------------------------------------------
def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of consecutive numbers (n, n + 1, ...) of length 2 or more in row order: first, n."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w) + 1) | F.lag(value).over(w).isNull(), F.lit(True)) | F.col(value).isNull()
    out = df.withColumn("_run", F.sum(new.cast("int")).over(w)).where(F.col(value).isNotNull())
    return out.groupBy(key, "_run").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("_run")


def boundaries_sum(df: DataFrame, key: str, order: str, boundary: Column, name: str = "run") -> DataFrame:
    """Number runs: a new one starts where boundary holds."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(name, F.sum(boundary.cast("int")).over(w))


def sliding(df: DataFrame, key: str, order: str, value: str, size: int = 3) -> DataFrame:
    """Windows of `size` rows at step 1; of fewer rows one window."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    got = df.withColumn("items", F.collect_list(value).over(w.rowsBetween(0, size - 1))).withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    return got.where((F.size("items") == size) | (F.col("_n") < size) & (F.col("_r") == 1)).select(key, order, "items")


def rate_windows(events: DataFrame, tenant: str, ts: str, quota: int, seconds: int = 60) -> DataFrame:
    """Events with their place in the tenant's fixed window; those beyond the quota aren't allowed."""
    start = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds
    w = Window.partitionBy(tenant, "window_start").orderBy(ts, "event_id")
    return events.withColumn("window_start", start).withColumn("place", F.row_number().over(w)).withColumn("allowed", F.col("place") <= quota)


def history(turns: DataFrame, key: str, order: str, text: str, messages: int = 6, chars: int = 2000) -> DataFrame:
    """The newest turns that aren't blank, up to a number and a sum of characters; a first one that is too long keeps its end."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    t = turns.where(F.trim(text) != "").withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = t.where((F.col("_n") <= messages) & ((F.col("_sum") <= chars) | (F.col("_n") == 1)))
    return kept.withColumn(text, F.right(F.col(text), F.lit(chars))).drop("_n", "_sum")


def after_cursor(df: DataFrame, cursor: list, columns: list[tuple[str, bool]], limit: int) -> DataFrame:
    """Keyset page: rows after the cursor by (column, descending?) pairs, in that order."""
    cond, equal = F.lit(False), F.lit(True)
    for value, (name, desc) in zip(cursor, columns):
        cond = cond | equal & ((F.col(name) < value) if desc else (F.col(name) > value))
        equal = equal & (F.col(name) == value)
    return df.where(cond).orderBy(*[F.desc(n) if d else F.asc(n) for n, d in columns]).limit(limit)


def next_cursor(df: DataFrame, cursor: list, columns: list[tuple[str, bool]], limit: int) -> DataFrame:
    """The key of a page's last row, as the cursor of the next one; no row if no row follows the page."""
    names = [n for n, _ in columns]
    page = after_cursor(df, cursor, columns, limit + 1).select(*names)
    place = F.row_number().over(Window.orderBy(*[F.desc(n) if d else F.asc(n) for n, d in columns]))  # of limit + 1 rows
    return page.withColumn("_k", place).withColumn("_n", F.count("*").over(Window.partitionBy())).where((F.col("_k") == limit) & (F.col("_n") > limit)).drop("_k", "_n")


def recent_distinct(events: DataFrame, user: str, item: str, order: list[Column], scan: int = 20, keep: int = 10) -> DataFrame:
    """Of a user's `scan` newest events the first `keep` distinct items by first appearance."""
    w = Window.partitionBy(user)
    newest = events.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= scan)
    first = newest.groupBy(user, item).agg(F.min("_r").alias("_first"))
    return first.withColumn("rank", F.row_number().over(w.orderBy("_first"))).where(F.col("rank") <= keep).drop("_first")
