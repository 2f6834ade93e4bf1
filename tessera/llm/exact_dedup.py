"""Exact duplicates by content sort, in DataFrame functions only.

Texts are equal when they are identical after every white-space byte (space, 09 to 0D) is
deleted. The normalised bytes are range-partitioned by sampled splitters, each partition is
sorted externally so that equal texts stand next to each other, and neighbours are compared
in full: a class is a run of the sort. Of a class the row with the most code points in the
original text stays, of equals the smallest doc_id.

Splitters are drawn from the first `head` characters and a hash of all bytes, so that what is
sampled is small however long the texts are, and texts that only begin alike are told apart.
A text with more rows than an even partition would hold is dealt to slices; there can be no
more such texts than partitions, which bounds the list of their hashes. Each slice is a run
of its own, and the leaders of the slices meet once more by their full normalised text.

Defined results: a null text counts as an empty one, and empty texts are one class; a null
doc_id comes after all others; of repeated rows of one doc_id exactly one is kept (`kept` is a
property of the row); texts of any length are compared whole; an empty table gives no rows;
columns other than doc_id and text aren't read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width, written

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def heavy_texts(rows: DataFrame, even: int) -> DataFrame:
    """(hash, slices) of hashes with more than `even` rows: at most rows / even of them."""
    spark = rows.sparkSession
    counts = rows.groupBy("hash").agg(F.count("*").alias("rows")).where(F.col("rows") > even)
    found = counts.select("hash", F.ceil(2 * F.col("rows") / even).alias("slices")).collect()
    return spark.createDataFrame([(r.hash, r.slices) for r in found], "hash long, slices long")


def runs(docs: DataFrame, head: int = 32, even: int | None = None) -> tuple[DataFrame, bool]:
    """One row per document with the leader, the size and the place in its run; whether some text has slices.

    doc_id, n_chars, sha (of the normalised text), lead_id, lead_chars, run_size, place, slice,
    and run_text: the normalised text, only at the first row of a slice.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    rows = rows.withColumns({"head": F.substring("norm", 1, head), "hash": F.xxhash64("norm")})
    even = even or max(1, docs.count() // shuffle_width(docs.sparkSession))
    heavy = heavy_texts(rows, even)
    sliced = not heavy.isEmpty()
    if sliced:
        # The partition counts too, so that repeats of one identical row are dealt out as well.
        dealt = F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), "slices")
        rows = rows.join(F.broadcast(heavy), "hash", "left").withColumn("slice", F.coalesce(dealt, F.lit(-1)).cast("int")).drop("slices")
    key = ["head", "hash", *["slice"] * sliced]
    ordered = Window.partitionBy(*key, "norm").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    run = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.repartitionByRange(*key).withColumns({"place": F.row_number().over(ordered), "lead_id": F.first("doc_id").over(run), "lead_chars": F.first("n_chars").over(run), "run_size": F.count("*").over(run)})
    slice_ = F.col("slice") if sliced else F.lit(-1)  # a constant in the key would make Spark shuffle again for the window
    text = F.when((slice_ >= 0) & (F.col("place") == 1), F.col("norm"))
    return placed.select("doc_id", "n_chars", F.sha2("norm", 256).alias("sha"), "lead_id", "lead_chars", "run_size", "place", slice_.alias("slice"), text.alias("run_text")), sliced


def exact_classes(docs: DataFrame, head: int = 32, even: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    even: rows of one text that a partition may hold before the text is dealt to slices; by
    default an even share of all rows.
    """
    placed, sliced = runs(docs, head, even)
    columns = ["doc_id", F.col("lead_id").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("kept"), F.col("sha").alias("text_sha256")]
    if not sliced:
        return placed.withColumn("kept", F.col("place") == 1).select(*columns)
    placed = written(placed, "exact-runs")
    best = F.min(F.struct(-F.col("lead_chars"), F.col("lead_id").isNull(), "lead_id", "slice"))
    whole = placed.where("run_text is not null").groupBy("run_text").agg(best.alias("best"), F.sum("run_size").alias("total"), F.first("sha").alias("sha"))
    whole = whole.select("sha", F.col("best.lead_id").alias("best_id"), F.col("best.slice").alias("best_slice"), "total")
    out = placed.join(whole, "sha", "left")
    merged = F.col("total").isNotNull()
    return out.select(
        "doc_id",
        F.when(merged, F.col("best_id")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.coalesce("total", "run_size").alias("group_size"),
        ((F.col("place") == 1) & (~merged | (F.col("slice") == F.col("best_slice")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and text_sha256 of the rows that stay, one of each class."""
    return exact_classes(docs, **limits).where("kept").select("doc_id", "text_sha256")


SQL = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY c DESC, doc_id)"""
