"""Captions, mentions, tables of contents, model rankings and resolution of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def caption(candidates: Column, direct: Column) -> Column:
    """struct(text, source, confidence): the first candidate (source, text) with a text, else the direct field."""
    ok = F.filter(candidates, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    first = F.get(ok, F.lit(0))
    text = F.coalesce(first["text"], F.nullif(F.trim(direct), F.lit("")))
    source = F.coalesce(first["source"], F.when(F.nullif(F.trim(direct), F.lit("")).isNotNull(), "direct"), F.lit("none"))
    confidence = F.when(source == "alt_text", 0.9).when(source == "notes", 0.7).when(source == "direct", 0.6).when(source == "none", 0.0).otherwise(0.5)
    return F.struct(text.alias("text"), source.alias("source"), confidence.alias("confidence"))


def caption_gate(existing: Column, media_type: Column, confidence: Column, least: float, ocr: Column) -> Column:
    """What becomes of an asset's caption."""
    return (
        F.when(F.trim(F.coalesce(existing, F.lit(""))) != "", "keep")
        .when(~media_type.startswith("image/"), "skip")
        .when(confidence >= least, "caption")
        .when(F.trim(F.coalesce(ocr, F.lit(""))) != "", "ocr")
        .otherwise("none")
    )


def mentions(comments: DataFrame, users: DataFrame) -> DataFrame:
    """comment_id, user_id of @names that exactly one user has."""
    one = users.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1")
    named = comments.select("comment_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"@([a-z0-9_#.-]+)"), F.lit(1)))).alias("name"))
    return named.join(one, "name").select("comment_id", "user_id").distinct()


def reference_expansion(matches: DataFrame, chunks: DataFrame, most: int = 5, each: int = 3) -> DataFrame:
    """query_id, id: matches and, of the first `most` distinct documents they refer to in order, the first `each` chunks.

    matches: query_id, id, rank, refs (array of documents); chunks: id, document, ord.
    """
    w = Window.partitionBy("query_id")
    refs = matches.select("query_id", "rank", F.posexplode("refs").alias("pos", "document"))
    first = refs.groupBy("query_id", "document").agg(F.min(F.struct("rank", "pos")).alias("at"))
    first = first.withColumn("n", F.row_number().over(w.orderBy("at", "document"))).where(F.col("n") <= most)
    top = chunks.withColumn("n", F.row_number().over(Window.partitionBy("document").orderBy("ord"))).where(F.col("n") <= each).select("id", "document")
    return matches.select("query_id", "id").union(first.select("query_id", "document").join(top, "document").select("query_id", "id")).distinct()


def model_ranking(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """query_id, id, score, rank of answers (query_id, json) that hold [{"candidate_id", "score"}]: clamped to 0-100, allowed ids once."""
    items = answers.select("query_id", F.posexplode(F.from_json("json", "array<struct<candidate_id: string, score: double>>")).alias("pos", "x")).select("query_id", "pos", F.col("x.candidate_id").alias("id"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("x.score"))).alias("score"))
    once = items.where("score IS NOT NULL").join(allowed, ["query_id", "id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))).where("n = 1")
    return once.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")).alias("rank"))


def web_selection(results: DataFrame, blocked: list[str], least: int = 40, top: int = 5) -> DataFrame:
    """query_id, id, rank, chosen: usable results in order; the first PDF is chosen, else the first.

    results: query_id, id, position, url, host, snippet, preselected, is_pdf.
    """
    bad_host = F.lit(False)
    for b in blocked:
        bad_host = bad_host | (F.col("host") == b) | F.col("host").endswith("." + b)
    s = F.lower(F.coalesce("snippet", F.lit("")))
    usable = (F.coalesce("url", F.lit("")) != "") & ((F.length(F.trim(s)) >= least) | F.col("preselected")) & ~bad_host & ~(F.contains(s, F.lit("noindex")) & F.contains(s, F.lit("robot")))
    w = Window.partitionBy("query_id")
    r = results.where(usable).withColumn("rank", F.row_number().over(w.orderBy("position", "id"))).where(F.col("rank") <= top)
    best = F.min(F.struct((~F.col("is_pdf")).cast("int"), F.col("rank"))).over(w)
    return r.withColumn("_best", best).select("query_id", "id", "rank", (F.col("rank") == F.col("_best.rank")).alias("chosen"))


def resolved_settings(items: DataFrame, by_host: DataFrame, by_provider: DataFrame, columns: list[str], defaults: dict) -> DataFrame:
    """Settings of each item (id, host, provider): the host's, else the provider's, else the default."""
    h = by_host.select("host", *[F.col(c).alias(f"h_{c}") for c in columns])
    p = by_provider.select("provider", *[F.col(c).alias(f"p_{c}") for c in columns])
    j = items.join(h, "host", "left").join(p, "provider", "left")
    return j.select("id", *[F.coalesce(f"h_{c}", f"p_{c}", F.lit(defaults[c])).alias(c) for c in columns])


def costs(events: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Sums of cost components; what isn't a number or is negative counts nothing."""
    part = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return events.groupBy(by).agg(F.round(F.sum(sum((part(c) for c in columns), F.lit(0.0))), 6).alias("cost"))


def same_content(a: Column, b: Column) -> Column:
    """Whether two metadata maps name the same content: by content_hash, else by hash."""
    key = lambda m: F.coalesce(F.try_element_at(m, F.lit("content_hash")), F.try_element_at(m, F.lit("hash")))
    return F.coalesce(key(a) == key(b), F.lit(False))


def document_radius(hits: DataFrame, radius: int = 1) -> DataFrame:
    """query_id, id, near: hits of one document within `radius` places of each other in retrieval order (query_id, id, doc, rank)."""
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank")))
    by = F.explode(F.array(*[F.lit(k) for k in range(-radius, radius + 1) if k]))
    asked = placed.select("query_id", "doc", "id", "place", by.alias("by")).select("query_id", "doc", "id", (F.col("place") + F.col("by")).alias("place"))
    return asked.join(placed.select("query_id", "doc", "place", F.col("id").alias("near")), ["query_id", "doc", "place"]).select("query_id", "id", "near")
