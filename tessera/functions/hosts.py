"""International host names in ASCII form (RFC 3492), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits and parameters of the encoding.
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASE, LEAST, MOST, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def digits(delta: Column, bias: Column) -> Column:
    """A number in variable-length digits."""

    def step(s: Column, k: Column) -> Column:
        t = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), k - bias))

        def with_t(t: Column) -> Column:
            last = s["q"] < t
            digit = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (BASE - t))
            return F.struct(whole((s["q"] - t) / (BASE - t)).alias("q"), last.alias("done"), F.concat(s["out"], F.substring(F.lit(DIGITS), digit.cast("int") + 1, F.lit(1))).alias("out"))

        return F.when(s["done"], s).otherwise(let(t.cast("long"), with_t))

    start = F.struct(delta.alias("q"), F.lit(False).alias("done"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(BASE), F.lit(BASE * 12), F.lit(BASE)), start, step)["out"]


def adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta."""
    start = let(F.when(first, whole(delta / DAMP)).otherwise(whole(delta / 2)), lambda d: F.struct((d + whole(d / points)).alias("d"), F.lit(0).cast("long").alias("k")))
    large = (BASE - LEAST) * MOST // 2
    step = lambda s, _: F.when(s["d"] > large, F.struct(whole(s["d"] / (BASE - LEAST)).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step), lambda s: s["k"] + whole(BASE * s["d"] / (s["d"] + SKEW)))


def encoded(label: Column) -> Column:
    """The ASCII form of one label that isn't ASCII, without its prefix."""
    points = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def with_points(points: Column) -> Column:
        basic = F.filter(points, lambda p: p < FIRST)
        b = F.size(basic).cast("long")
        head = F.array_join(F.transform(basic, lambda p: F.char(p)), "")
        start = F.struct(F.lit(FIRST).cast("long").alias("n"), F.lit(0).cast("long").alias("delta"), F.lit(BIAS).cast("long").alias("bias"), b.alias("h"), F.when(b > 0, F.concat(head, F.lit("-"))).otherwise("").alias("out"))

        def insert(s: Column, p: Column) -> Column:
            put = F.struct(
                s["n"].alias("n"), F.lit(0).cast("long").alias("delta"), adapted(s["delta"], s["h"] + 1, s["h"] == b).alias("bias"),
                (s["h"] + 1).alias("h"), F.concat(s["out"], digits(s["delta"], s["bias"])).alias("out"),
            )
            more = F.struct(s["n"].alias("n"), (s["delta"] + 1).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            return F.when(p == s["n"], put).when(p < s["n"], more).otherwise(s)

        def round_(s: Column, m: Column) -> Column:
            begun = F.struct(m.alias("n"), (s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))
            return let(F.aggregate(points, begun, insert), lambda e: F.struct((e["n"] + 1).alias("n"), (e["delta"] + 1).alias("delta"), e["bias"].alias("bias"), e["h"].alias("h"), e["out"].alias("out")))

        return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST))), start, round_)["out"]

    return let(points, with_points)


def ascii_host(host: Column) -> Column:
    """A host in lower case with its international labels as xn--...; as it is where a label would be empty or too long.

    Labels are lower-cased, sharp s is ss and a final sigma a sigma; other compatibility forms
    are expected to be composed already.
    """
    low = F.lower(host)
    plain = F.replace(F.replace(F.regexp_replace(low, "[。．｡]", "."), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    labels = F.transform(F.split(plain, "[.]"), lambda x: F.when(x.rlike(r"^[\x00-\x7f]*$"), x).otherwise(F.concat(F.lit("xn--"), encoded(x))))
    fits = lambda x: F.forall(F.slice(x, 1, F.greatest(F.lit(1), F.size(x) - F.when(F.element_at(x, -1) == "", 1).otherwise(0))), lambda y: (y != "") & (F.length(y) < 64))
    return F.when(low.rlike(r"^[\x00-\x7f]*$"), low).otherwise(let(labels, lambda x: F.when(fits(x), F.array_join(x, ".")).otherwise(low)))
