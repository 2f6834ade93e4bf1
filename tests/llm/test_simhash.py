import random

import numpy as np
import xxhash

from tessera.llm import simhash as sh
from tessera.llm.graph import components


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def some_fingerprints(n, seed):
    r = random.Random(seed)
    fps = [r.getrandbits(64) for _ in range(n // 4)] + [0, 1]
    while len(fps) < n:
        x = r.choice(fps)
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    return sorted(set(fps))


def test_golay_table():
    fold, errors = sh.golay()
    assert {int((e >= 0).sum()) for e in errors} == {1, 6}
    assert sorted({int(e[0]).bit_count() for e in errors}) == [0, 1, 2, 3]
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 23, 2000)
    y = x ^ (1 << r.integers(0, 23, 2000))
    near, probe = sh.near_codewords(y), sh.near_codewords(x)[:, 0]
    assert (near == probe[:, None]).any(axis=1).all()


def test_keys_meet():
    r = random.Random(2)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        who, key, probe = sh.keys(np.array([x, y], np.uint64).view(np.int64))
        assert set(key[(who == 0) & probe]) & set(key[who == 1])


def test_fingerprints():
    for t in ["", None, " \n", "a", "A b", "a b c", "Á b\tc d", "the cat sat on the mat " * 50, "x\x1cy z w", "a b c " * 40000]:
        assert sh.fingerprint(t) == plain_fingerprint(t)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(60)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10} | {100 + i: 100 for i in range(61)} | {1000 + i: 1000 for i in range(100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_both_ways(spark):
    fps = some_fingerprints(260, 3)
    want = brute_components(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for dense in (4096, 2):
        got = {r.node: r.component for r in components(sh.links(df, dense=dense)).collect()}
        for i, x in enumerate(signed):
            for j in range(i):
                assert (got.get(x, x) == got.get(signed[j], signed[j])) == (want[i] == want[j])


def test_documents(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(6)]
    texts = base + [b[:-8] + " q" * r.randint(0, 4) for b in base for _ in range(5)] + [None, "", "Hi", "hi", "hi you"]
    rows = [(10 * i + 3, t, "x") for i, t in enumerate(texts)] + [(3, base[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sh.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    label = brute_components(fps)
    least = {}
    for (d, _, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    want = sorted((d, f"{f:016x}", least[x]) for (d, _, _), f, x in zip(rows, fps, label))
    assert sorted(map(tuple, got)) == want
    kept = sh.one_of_each(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(least.values()))
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_dense_bucket_last_of_its_partition(spark):
    base = 0x5A5A5A5A5A5A5A5A
    fps = [base] + [base ^ 1 << b for b in range(22)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for width in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        try:
            got = {r.node: r.component for r in components(sh.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=2)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == dict.fromkeys(signed, min(signed))
