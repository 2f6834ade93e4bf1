import random
import zlib
from collections import defaultdict

from tessera.llm import sharding as sh


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= s]
        if fits:
            bins[min(fits)[1]] -= s
        else:
            bins.append(max(capacity, s) - s)
    return bins


def test_pack_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(40):
        sizes = [r.randint(1, 40) for _ in range(r.randint(1, 200))]
        capacity = r.randint(20, 80)
        histogram = [(s, sizes.count(s)) for s in set(sizes)]
        runs = sh.pack(histogram, capacity)
        load = defaultdict(int)
        for s, first, end, b in runs:
            load[b] += s * (end - first)
        assert sum(end - first for _, first, end, _ in runs) == len(sizes)
        assert all(v <= max(capacity, max(sizes)) for v in load.values())
        assert len(load) == len(plain_best_fit(sizes, capacity))


def test_least_capacity():
    histogram = [(s, 3) for s in range(1, 50)]
    c = sh.least_capacity(histogram, 8)
    assert sh.pack(histogram, c, 8) is not None and c <= 1.02 * sum(s * n for s, n in histogram) / 8


def test_documents(spark):
    r = random.Random(4)
    texts = ["x" * r.randint(0, 300) + str(r.randint(0, 50)) for _ in range(800)] + ["copy é"] * 200 + [None, "", ""]
    rows = [(i, t, 99) for i, t in enumerate(texts)] + [(5, texts[5], 99), (None, "no id", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sh.shards_by_bytes(df).collect()
    assert len(got) == len(rows)
    text = dict((i, t) for i, t, _ in rows)
    where, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for x in got:
        raw = (text[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        where[raw].add(x.shard)
        slots[x.shard].append(x.slot)
        load[x.shard] += x.size
    assert all(len(s) == 1 for s in where.values()) and set(load) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.02 * min(load.values())
    assert sh.shards_by_bytes(df.limit(0)).count() == 0
    few = sh.assigned(df, None, capacity=5000).groupBy("shard").agg({"size": "sum"}).collect()
    assert all(s <= 5000 for _, s in few)


def test_large_groups_leave_the_rest_even():
    for sizes in ([700] + [1] * 1400, [315] + [1] * 1785, [900, 400, 300] + [2] * 500, [50] * 3, [600, 600] + [5] * 100):
        histogram = [(s, sizes.count(s)) for s in set(sizes)]
        load, ranks = defaultdict(int), defaultdict(list)
        for s, first, end, b in sh.pack_evenly(histogram, 8):
            load[b] += s * (end - first)
            ranks[s] += range(first, end)
        assert all(sorted(ranks[s]) == list(range(n)) for s, n in histogram)
        large = [s for s in sizes if s >= 300]
        if len(sizes) > 8:
            rest = sorted(load.values())[: 8 - len(large)]
            assert len(load) == 8 and sorted(load.values())[8 - len(large) :] == sorted(large)
            assert max(rest) <= sum(rest) / len(rest) + 5
