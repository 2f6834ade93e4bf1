"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups are the rows of equal texts. Sorted by size, each enters the bin with the tightest
remaining capacity that holds it; bins stand in a balanced tree by remaining capacity. Only a
histogram of group sizes comes to the driver: sizes keep `digits` significant bits
(rounded up), so it has at most 2^digits entries for each doubling of the largest size,
whatever the number of rows. Groups of one size class are alike for the packing, which
assigns runs of them; which group is which in its class is settled by distributed ranks.

With a given number of shards, a group over the mean of what is left has a shard of its own;
the rest gets the least capacity with which the packing needs no more than the other bins
(found by bisection), so sizes are as near equal as indivisible groups allow. A given
capacity gets as few bins as best fit finds. A group above the capacity has a bin of its own.

Ranks and slots are counts over (shard or class, salt) pairs with a window in each: no task
holds a whole shard.

Defined results: a null text is an empty one, of size 1; equal texts go together whatever
their doc_ids; repeated rows are rows of their own; ties are ordered by a hash of the text,
then by doc_id; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut


class Tree:
    """A treap of (remaining capacity, bin): insert, and take the least that holds a size."""

    def __init__(self, seed: int = 1):
        self.root, self.random = None, random.Random(seed)

    def _split(self, node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with at least `size` left."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        _, high = self._split(high, (least[0][0], least[0][1] + 1))
        self.root = self._merge(low, high)
        return least[0]


def pack(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best fit decreasing: (size, first rank, end rank, bin) runs of the groups of each size.

    histogram: (size, groups). With `bins`, None if they don't suffice.
    """
    tree, used, runs = Tree(), 0, []
    for b in range(bins or 0):
        tree.insert((capacity, b))
    used = bins or 0
    for size, count in sorted(histogram, reverse=True):
        at = 0
        while at < count:
            found = tree.take(size)
            if found is None:
                if bins:
                    return None
                found = (max(capacity, size), used)
                used += 1
            left, b = found
            n = min(count - at, left // size)  # it stays the tightest as long as it holds one more
            runs.append((size, at, at + n, b))
            tree.insert((left - n * size, b))
            at += n
    return runs


def least_capacity(histogram: list[tuple[int, int]], bins: int) -> int:
    """The least capacity, found by bisection, with which the packing needs at most `bins` bins."""
    total = sum(s * n for s, n in histogram)
    low, high = max(-(-total // bins), max(s for s, _ in histogram)), None
    step = max(1, total // bins >> 12)
    while pack(histogram, low, bins) is None:
        high, low, step = None, low + step, step * 2
    step //= 2
    high, low = low, max(low - step, max(-(-total // bins), max(s for s, _ in histogram)))
    while low < high:
        mid = (low + high) // 2
        if pack(histogram, mid, bins) is None:
            low = mid + 1
        else:
            high = mid
    return high


def pack_evenly(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Runs as of pack(): groups over the mean of what is left have bins of their own, the rest shares the others evenly."""
    total, own, alone, rest = sum(s * n for s, n in histogram), 0, {}, []
    for size, count in sorted(histogram, reverse=True):
        while alone.get(size, 0) < count and own < bins - 1 and size * (bins - own) > total:
            alone[size] = alone.get(size, 0) + 1
            own, total = own + 1, total - size
        if count > alone.get(size, 0):
            rest.append((size, count - alone.get(size, 0)))
    runs, b = [], 0
    for size, count in alone.items():
        runs += [(size, k, k + 1, b + k) for k in range(count)]
        b += count
    if rest:
        runs += [(s, first + alone.get(s, 0), end + alone.get(s, 0), b + own) for s, first, end, b in pack(rest, least_capacity(rest, bins - own), bins - own)]
    return runs


def size_class(size: Column, digits: int) -> Column:
    """The size with `digits` significant bits, rounded up."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") + 1 - digits)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return F.ceil(size / unit).cast("long") * unit


def ranked(df: DataFrame, by: str, order: list[str], name: str, salts: int) -> DataFrame:
    """A gapless rank from 0 within `by`: counted by salt, then within (by, salt)."""
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(by, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(counts, [by, "_salt"]).withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_salt", "_inside", "_before")


def assigned(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, digits: int = 12, salts: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; give `shards` or `capacity`."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group_key")))
    groups = base.groupBy("group_key", "size").agg((F.count("*") * F.col("size")).alias("total"))
    groups = cut(groups.select("group_key", size_class(F.col("total"), digits).alias("class")))
    histogram = [(r["class"], r.n) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()]
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("class", "first", "end")] + [T.StructField("shard", T.IntegerType())])
    runs = []
    if histogram:
        runs = pack(histogram, capacity, None) if capacity else pack_evenly(histogram, shards)
    runs = F.broadcast(spark.createDataFrame(runs, kind))  # at most a run for each size class and bin change
    placed = ranked(groups, "class", ["group_key"], "rank", salts)
    placed = placed.join(runs, "class").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select("group_key", "shard")
    rows = cut(base.join(placed, "group_key"))
    return ranked(rows, "shard", ["text_crc32", "doc_id"], "slot", salts).select("doc_id", "size", "text_crc32", "shard", "slot")


def shards_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The contract's columns; law `bytes`: sizes near equal."""
    return assigned(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
