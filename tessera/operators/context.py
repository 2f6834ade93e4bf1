"""Context around retrieved chunks: neighbours of the best ones, passages, and what fits a budget.

Each query's chunks are cut to a pool of its best before they are gathered, so that what one
row holds is bounded. Neighbours come from windows; the choice from best to least is a fold
over the pool, in which a chunk that an earlier one has taken gives nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDS = "array<long>"


def pooled(chunks: DataFrame, pool: int) -> DataFrame:
    """The best rows of each query by score, then id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return chunks.withColumn("_k", place).where(F.col("_k") <= pool)


def beside(chunks: DataFrame, *fields: str) -> Column:
    """The chunks before and after one in its document and section, by their retrieval order n, as structs that begin with n and id."""
    w = Window.partitionBy("query_id", "doc", "section").orderBy(F.col("ord").asc_nulls_last(), "id")
    it = F.struct("n", "id", *fields)
    return F.when(F.col("doc").isNotNull(), F.array_sort(F.array_compact(F.array(F.lag(it).over(w), F.lead(it).over(w))))).otherwise(F.array().cast("array<struct<n:bigint,id:bigint" + "".join(f",{f}:{dict(chunks.dtypes)[f]}" for f in fields) + ">>"))


def is_title(text: Column, depth: Column) -> Column:
    """A short text that asks nothing and ends with a colon, or is very short in a section at the top."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.size(F.split(t, r"\s+"))
    short = (t != "") & (F.length(t) <= 220) & ~F.contains(t, F.lit("?")) & (words <= 30)
    return F.coalesce(short & (F.endswith(t, F.lit(":")) | ((depth <= 1) & (words <= 20))), F.lit(False))


def expanded(snippets: DataFrame, pool: int = 200) -> DataFrame:
    """query_id, id, pos: best snippets first, each followed by its neighbours that no earlier one has taken.

    snippets: query_id, id, doc, section (array), ord, score, text, n (their retrieval order),
    ids unique in a query. Neighbours are those beside it in its section, by n, and for a title
    those beside it among the document's snippets in retrieval order.
    """
    s = pooled(snippets.withColumns({"n": F.col("n").cast("long"), "id": F.col("id").cast("long")}), pool)
    near = s.withColumn("near", beside(s))
    of_doc = Window.partitionBy("query_id", "doc").orderBy("n", "id")
    title = F.col("doc").isNotNull() & is_title(F.col("text"), F.size("section"))
    more = F.when(title, F.array_compact(F.array(F.lag("id").over(of_doc), F.lead("id").over(of_doc)))).otherwise(F.array().cast(IDS))
    ids = F.concat(F.transform("near", lambda x: x["id"]), "more")
    anchors = near.withColumn("more", more).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_k", "id", ids.alias("ids")))).alias("anchors"))
    step = lambda out, a: F.when(F.array_contains(out, a["id"]), out).otherwise(F.concat(out, F.array(a["id"]), F.array_except(a["ids"], F.concat(out, F.array(a["id"])))))
    return anchors.select("query_id", F.posexplode(F.aggregate("anchors", F.array().cast(IDS), step)).alias("pos", "id"))


def within_budget(snippets: DataFrame, budget: int, primary: DataFrame | None = None, pool: int = 200) -> DataFrame:
    """query_id, id, rank, tokens, used_tokens: expanded snippets up to the first that overflows the budget.

    primary: query_id, doc: that document's snippets come first, by their place in it. Snippets
    without text count and cost nothing.
    """
    tokens = F.when(F.col("text") != "", F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int"))).otherwise(0)
    at = expanded(snippets, pool).join(snippets.select("query_id", "id", "doc", "ord", tokens.alias("tokens")), ["query_id", "id"])
    leads = F.lit(False)
    if primary is not None:
        at = at.join(primary.select("query_id", F.col("doc").alias("_lead")), "query_id", "left")
        leads = F.coalesce(F.col("doc") == F.col("_lead"), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(F.desc("_first"), F.when(F.col("_first"), F.coalesce("ord", F.lit(0))), "pos")
    at = at.withColumn("_first", leads).where("tokens > 0")
    at = at.withColumns({"rank": F.row_number().over(order), "used_tokens": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return at.where(F.col("used_tokens") <= budget).select("query_id", "id", "rank", "tokens", "used_tokens")


def passages(chunks: DataFrame, most: int = 450, pool: int = 200) -> DataFrame:
    """query_id, passage_id, ids, text, score, rank: chunks with those beside them in their section, within a budget of tokens.

    chunks: query_id, id, doc, section, ord, score, tokens, n (their retrieval order), text. From
    best to least, a chunk that no earlier passage has opens one; a neighbour that is too long
    is left out and the other tried. Passages without text aren't given, but have their chunks.
    """
    s = pooled(chunks.withColumns({"n": F.col("n").cast("long"), "id": F.col("id").cast("long"), "tokens": F.col("tokens").cast("long")}), pool)
    one = "struct<n:bigint,id:bigint,tokens:bigint>"
    anchors = s.withColumn("near", beside(s, "tokens")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_k", "n", "id", "tokens", "near"))).alias("anchors"))
    start = F.struct(F.array().cast(IDS).alias("used"), F.array().cast(f"array<struct<id:bigint,parts:array<{one}>>>").alias("out"))

    def step(state: Column, a: Column) -> Column:
        own = F.struct(a["n"].alias("n"), a["id"].alias("id"), a["tokens"].alias("tokens"))
        free = F.filter(a["near"], lambda x: ~F.array_contains(state["used"], x["id"]))
        begun = F.struct(F.array(own).alias("parts"), (F.lit(most) - a["tokens"]).alias("left"))
        fits = lambda t, x: (t["left"] > 0) & (x["tokens"] <= t["left"])
        parts = F.aggregate(free, begun, lambda t, x: F.when(fits(t, x), F.struct(F.concat(t["parts"], F.array(x)).alias("parts"), (t["left"] - x["tokens"]).alias("left"))).otherwise(t))["parts"]
        made = F.struct(a["id"].alias("id"), F.array_sort(parts).alias("parts"))
        grown = F.struct(F.concat(state["used"], F.transform(parts, lambda x: x["id"])).alias("used"), F.concat(state["out"], F.array(made)).alias("out"))
        return F.when(F.array_contains(state["used"], a["id"]), state).otherwise(grown)

    found = anchors.select("query_id", F.explode(F.aggregate("anchors", start, step)["out"]).alias("p")).select("query_id", F.col("p.id").alias("passage_id"), F.posexplode("p.parts").alias("pos", "x"))
    rows = found.select("query_id", "passage_id", "pos", F.col("x.id").alias("id")).join(chunks.select("query_id", "id", "score", "text"), ["query_id", "id"])
    each = rows.groupBy("query_id", "passage_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("text", F.lit("")).alias("text")))).alias("x"), F.max("score").alias("score"))
    text = F.btrim(F.array_join(F.transform("x", lambda x: x["text"]), "\n\n"), F.lit(" \t\n\x0b\x0c\r"))
    out = each.select("query_id", "passage_id", F.transform("x", lambda x: x["id"]).alias("ids"), text.alias("text"), "score").where("text != ''")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("passage_id").cast("string"))))
