"""Vectors as arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scored import by_vectors
from .stages import cut

#: Squared norms up to this count as zero.
ZERO = 1e-12


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column) -> Column:
    return F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norm = F.sqrt(squared(a)) * F.sqrt(squared(b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector of norm 1, null for a zero one."""
    n = squared(a)
    return F.when(n > ZERO, F.transform(_double(a), lambda x: x / F.sqrt(n)))


def is_valid(a: Column, dimension: int) -> Column:
    """Finite numbers, as many as asked for, and no zero vector."""
    finite = F.forall(_double(a), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & (F.size(a) == dimension) & finite & (squared(a) > ZERO)


def l2_to_cosine(d: Column) -> Column:
    return 1 - d * d / 2


def cosine_to_l2(t: Column) -> Column:
    return F.sqrt(2 * (1 - t))


def cutoff_similarity(d: Column, cutoff: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / cutoff)


def inverse_score(d: Column) -> Column:
    return 1 / (1 + d)


def linear_score(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def parse(literal: Column) -> Column:
    return F.split(F.regexp_replace(literal, r"[\[\]\s]", ""), ",").cast("array<double>")


def six_decimals(x: Column) -> Column:
    """printf's %.6f: the nearest by the exact binary value, halves to the even digit. Java's own form rounds the shortest decimal form instead.

    Both are the same away from halves. The fraction's upper and lower half have at most 27 bits each, so their products with a million are exact.
    From 2**106 on the digits are Java's.
    """
    plain = (F.abs(x) < 1e6) & (F.abs(x * 1e6 - F.rint(x * 1e6)) < 0.499)
    whole = F.floor(F.abs(x)).cast("long")
    fraction = F.abs(x) - whole
    upper = fraction * 134_217_729.0 - (fraction * 134_217_729.0 - fraction)
    high, low = upper * 1e6, (fraction - upper) * 1e6
    near = F.rint(high)
    over, under, odd = 0.5 - (high - near), 0.5 + (high - near), near % 2 == 1
    n = (near + F.when((low > over) | (low == over) & odd, 1).when((-low > under) | (-low == under) & odd, -1).otherwise(0)).cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    above = F.floor(F.abs(x) / 2.0**53)
    large = F.when(F.abs(x) < 2.0**106, above.cast("long").cast("decimal(19,0)") * F.lit(2**53).cast("decimal(18,0)") + (F.abs(x) - above * 2.0**53).cast("long"))
    digits = F.format_string("%s%d.%06d", sign, whole + F.when(n == 1_000_000, 1).otherwise(0), n % 1_000_000)
    return F.when(plain, F.format_string("%.6f", x)).when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(F.abs(x) >= 2.0**106, F.format_string("%.6f", x)).when(F.abs(x) >= 2.0**53, F.concat(sign, large.cast("string"), F.lit(".000000"))).when(x.isNotNull(), digits)


def literal(a: Column) -> Column:
    """[x,y,...] with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(_double(a), six_decimals), ","), F.lit("]"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, centroid (mean of the vectors), is_unit: all of a key's vectors have norm 1. Zero centroids go."""
    each = df.select(key, F.posexplode(_double(F.col(vector))).alias("pos", "x"))
    means = each.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    out = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    sizes = df.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.abs(squared(F.col(vector)) - 1) < 1e-3).alias("is_unit"))
    return out.join(sizes, key).where(squared(F.col("centroid")) > ZERO).select(key, "n", "centroid", "is_unit")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two sets; both_empty is 1 among stored documents, 0 among web results."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", id_: str = "id", broadcast_rows: int = 10_000) -> DataFrame:
    """query_id, id, distance (1 - cosine), rank: the k nearest by exact search.

    queries (query_id, q) is the stated query set, sent in blocks of about `broadcast_rows` rows;
    a task keeps k rows of each query, and only these are shuffled. Vectors of different lengths aren't compared.
    """
    from pyspark.sql import Window

    one = {"grp": F.lit(0), "scope": F.lit(0)}
    asked = cut(queries.select(query_id, unit(F.col("q")).alias("unit")).where("unit IS NOT NULL").withColumn("no", F.monotonically_increasing_id()))
    held = corpus.select(F.col(id_).alias("id"), F.lit(0).alias("grp"), F.array(F.lit(0)).alias("seen"), unit(F.col("v")).alias("unit")).where("unit IS NOT NULL")
    near = by_vectors(asked.select("no", "unit", *[c.alias(n) for n, c in one.items()]), held, k, broadcast_rows).join(asked.select("no", query_id).hint("merge"), "no")
    near = near.select(query_id, F.col("id").alias(id_), F.col("cost").alias("distance"))
    w = Window.partitionBy(query_id).orderBy("distance", id_)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
