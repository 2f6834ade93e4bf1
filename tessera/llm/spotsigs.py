"""SpotSigs document fingerprints, in DataFrame functions only.

Common words of four languages are anchors. A run of anchors together with the chain of the
`chain` content words that follow it forms a signature; a text's fingerprint is its set of
signatures, kept as sorted 64-bit hashes. Texts without a signature fall back on the chains
at all their content words, and texts without words on the text itself.

Likeness of two fingerprints is the Jaccard coefficient of their sets. The coefficient can't
exceed the ratio of the smaller to the larger size; `likeness` with a threshold leaves out
pairs below that bound, and `similar_pairs` partitions fingerprints by size so that only
neighbouring partitions meet, through the rarest signatures of each set (a prefix long
enough that similar sets share one), and verifies the rest of the bound before it intersects.

Defined results: a null text is an empty one, whose set holds the hash of the empty text, so
equal texts have equal fingerprints and likeness 1; repeated rows give repeated results; an
empty table gives no rows; columns but doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, shuffle_width

# Anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "the a an and of to in is are was be it that this with for on as at by or from not have has had but they he she we you his her its their "
    "der die das und ist von zu den dem des ein eine einen mit auf nicht im für sich auch als wie oder bei aus nach war wird "
    "le la les un une et est que qui dans pour par sur au aux avec du ce elle il ne pas plus se sont en de ou "
    "el los las y una es por con para del al lo como más su sus no o pero fue ser"
).split()


#: What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for all of its uses."""
    return F.transform(F.array(value), body)[0]


def content_items(text: Column) -> Column:
    """The content words of a text, each with the run of anchors before it: "of>the>house"."""
    anchors = sorted({*ANCHORS})
    tied = F.transform(F.split(F.lower(text), BETWEEN), lambda w: F.concat(w, F.when(w.isin(anchors), ">").otherwise(" ")))
    return F.filter(F.split(F.array_join(tied, ""), " "), lambda x: x != "")


def signatures(text: Column, chain: int = 3) -> Column:
    """The sorted distinct signature hashes of a text; `chain` content words each."""
    text = F.coalesce(text, F.lit(""))

    def of(items: Column) -> Column:
        return let(F.struct(items.alias("i"), F.transform(items, lambda x: F.substring_index(x, ">", -1)).alias("w")), hashes)

    def hashes(s: Column) -> Column:
        hashed = lambda x, k: F.xxhash64(x, *[F.get(s["w"], k + j) for j in range(1, chain)])
        anchored = F.filter(F.transform(s["i"], lambda x, k: F.when(F.contains(x, F.lit(">")), hashed(x, k))), lambda h: h.isNotNull())
        return F.when(F.size(s["w"]) == 0, F.array(F.xxhash64(text))).otherwise(let(anchored, lambda a: F.when(F.size(a) > 0, a).otherwise(F.transform(s["w"], hashed))))

    return F.array_sort(F.array_distinct(let(content_items(text), of)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 where their sizes show that it is below `least`."""
    smaller, larger = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(smaller < larger * least, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprint(sigs: Column) -> Column:
    """A set of signatures as a string: its size and a hash of its sorted members."""
    return F.concat_ws(":", F.size(sigs), F.lower(F.lpad(F.hex(F.xxhash64(sigs)), 16, "0")))


def fingerprints(docs: DataFrame, chain: int = 3) -> DataFrame:
    """doc_id, signatures (the set) and fingerprint of every whole text."""
    return docs.select("doc_id", signatures(F.col("text"), chain).alias("signatures")).withColumn("fingerprint", fingerprint(F.col("signatures")))


def size_partition(n: Column, threshold: float) -> Column:
    """Sets whose sizes can reach the threshold are in the same or in neighbouring partitions."""
    from math import log

    return F.floor(F.log(n.cast("double")) / -log(threshold) + 1e-9).cast("int")


def similar_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): likeness of at least `threshold` (below 1) between classes of equal sets.

    pairs: a, b, likeness of class representatives; members: doc_id, representative. A set
    meets others in its partition and the one below through its rarest signatures.
    """
    found = docs.select("doc_id", signatures(F.col("text"), chain).alias("s"))
    members = cut(found.select("doc_id", F.xxhash64("s").alias("h"), F.size("s").alias("n"), "s"))
    classes = members.groupBy("h", "n").agg(F.min("doc_id").alias("a"), F.first("s").alias("s"))
    classes = cut(classes.withColumn("p", size_partition(F.col("n"), threshold)))
    counts = classes.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("k"))
    each = classes.select("a", "n", "p", F.explode("s").alias("g")).join(counts, "g")
    prefix = F.slice(F.array_sort(F.collect_list(F.struct("k", "g"))), 1, F.first("n") - F.ceil(F.first("n") * threshold - 1e-9).cast("int") + 1)
    keys = cut(each.groupBy("a").agg(F.first("n").alias("n"), F.first("p").alias("p"), prefix.alias("g")).select("a", "n", "p", F.explode("g.g").alias("g")))
    low = keys.select(F.col("a").alias("b"), F.col("n").alias("m"), F.explode(F.array("p", F.col("p") + 1)).alias("p"), "g")
    ordered = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("b") < F.col("a"))
    pairs = keys.join(low, ["p", "g"]).where(ordered & (F.col("m") >= F.col("n") * threshold - 1e-9)).select("a", "b").distinct()
    side = lambda x, y: classes.select(F.col("a").alias(x), F.col("s").alias(y))
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("likeness", likeness(F.col("x"), F.col("y"), threshold))
    reps = members.select("doc_id", "h", "n").join(classes.select("h", "n", F.col("a").alias("representative")), ["h", "n"])
    return pairs.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), reps.select("doc_id", "representative")


def neighbours(ids: DataFrame, width: int) -> DataFrame:
    """For each row (k, occ, n) the row of which it is the next one, descending: to_k, to_occ, to_chars.

    Ids are sorted in ranges; only the last row of each range goes through one task, `width`
    rows at most.
    """
    ids = cut(ids.repartitionByRange(width, F.col("k").desc()).withColumn("range", F.spark_partition_id()))
    row = F.struct("k", "occ", "n")
    ends = ids.groupBy("range").agg(F.max_by(row, F.struct(-F.col("k").cast("decimal(20,0)"), "occ")).alias("end"))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lag("end").over(Window.orderBy("range")), F.last("end").over(whole)).alias("before"))
    before = F.lag(row).over(Window.partitionBy("range").orderBy(F.col("k").desc(), "occ"))
    linked = ids.withColumn("to", before).join(F.broadcast(ends), "range").withColumn("to", F.coalesce("to", "before"))
    return linked.select(F.col("k").alias("from_k"), F.col("occ").alias("from_occ"), F.col("to.k").alias("to_k"), F.col("to.occ").alias("to_occ"), F.col("to.n").alias("to_chars"))


def edited_and_next(docs: DataFrame, chain: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last third (rounded down) replaced by as many first
    code points of the next document, descending doc_id; after the last comes the first.
    Texts are shuffled once by doc_id; of the next document only the part that is needed and
    its signatures travel to the document before it. Rows of equal doc_ids are ordered by a
    hash of their texts; a null doc_id comes last (-2^63 can't be told from it).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("k"), text.alias("text"))  # both uses read the same columns, so that they share one exchange
    rows = rows.withColumn("occ", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("text"), F.length("text"))))
    ids = docs.select(key.alias("k"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    ids = ids.withColumn("occ", F.row_number().over(Window.partitionBy("k").orderBy("h", "n"))).select("k", "occ", "n")
    links = neighbours(ids, shuffle_width(spark))
    given = rows.join(links, (F.col("k") == F.col("from_k")) & (F.col("occ") - F.col("from_occ") == 0))
    given = given.select("to_k", "to_occ", F.expr("substring(text, 1, to_chars div 3)").alias("lent"), signatures(F.col("text"), chain).alias("next_sigs"))
    met = rows.join(given, (F.col("k") == F.col("to_k")) & (F.col("occ") - F.col("to_occ") == 0))
    n = F.length("text")
    met = met.select(F.nullif("k", F.lit(-(2**63))).alias("doc_id"), n.cast("long").alias("n_chars"), "text", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), "lent").alias("edited"), "next_sigs")
    met = met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text"), chain).alias("sigs"), signatures(F.col("edited"), chain).alias("edited_sigs"), "next_sigs")
    own, edited, following = F.col("sigs"), F.col("edited_sigs"), F.col("next_sigs")
    return met.select("doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))
