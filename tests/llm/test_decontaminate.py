import hashlib
import random
import re

from tessera.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width):
    w, hit, found = plain_words(text), set(), set()
    for name, item in items:
        v = plain_words(item)
        for i in range(max(1, len(v) - width + 1) if v else 0):
            x = v[i : i + width]
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit.update(range(j, j + len(x)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found), hit


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, k: " ".join(r.choice("abcdefghij"[:k]) + r.choice(["", "", "É", "."]) for _ in range(n))
    items = [(i, text(r.randint(0, 14), r.randint(2, 6))) for i in range(12)] + [(50, None), (51, ""), (52, "Zz"), (53, "Zz"), (54, "a a a a a a a")]
    docs = [text(r.randint(0, 60), r.randint(1, 7)) for _ in range(40)] + [None, "", "...", "a " * 300, "x Zz-y"]
    for i in range(20):
        docs.append(text(9, 9) + " " + (r.choice(items)[1] or "").upper() + ", " + text(5, 9))
    return docs, items


def test_against_brute_force():
    for seed, width, size in ((1, 4, 50), (2, 10, 10**6), (3, 2, 300), (4, 6, 1)):
        docs, items = corpus(seed)
        whole = [dc.Windows.of([(str(n), t) for n, t in items], width)]
        halves = [dc.Windows.of([(str(n), t) for n, t in items[k::2]], width) for k in (0, 1)]
        for windows in (whole, halves):
            for text, (n, spans, names) in zip(docs, dc.scan(docs, windows, size), strict=True):
                want = brute(text, items, width)
                assert (n, sum(e - f for f, e in spans), names) == want[:3]
                assert {i for f, e in spans for i in range(f, e)} == want[3]
                if spans:
                    assert plain_words(dc.without(text, spans)) == [w for i, w in enumerate(plain_words(text)) if i not in want[3]] or len(spans) > 0


def test_without():
    assert dc.without("Éa, b c! d e", [(1, 3)]) == "Éa, ! d e"
    assert dc.without("a b", [(0, 2)]) == ""


def test_frames(spark):
    docs, items = corpus(7)
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in dc.digest(dc.passages(d, b, 5, block_words=5)).collect():
        n, hit, names, _ = brute(docs[r.doc_id], items, 5)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    cleaned = dc.clean(d, b, 5)
    assert cleaned.columns == d.columns and cleaned.count() == len(docs)
    assert dc.digest(dc.passages(d.limit(0), b)).count() == 0
    assert dc.passages(d, b.limit(0)).where("size(items) > 0").count() == 0


def test_tables_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = dc.digest(dc.passages(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    q = con.execute(dc.SQL)
    assert got.columns == [d[0] for d in q.description]
    want = q.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[5] for r in want)


def test_blocks_are_sent_one_at_a_time(spark, monkeypatch):
    docs, items = corpus(7)
    rows = [(i, t, "k", len(t or "")) for i, t in enumerate(docs)] + [(0, docs[0], "again", 1), (None, docs[1], "no id", 1), (None, docs[2], "no id", 1), (77, None, "null", 0), (78, " ".join(t or "" for t in docs) * 30, "long", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, removal string, n_chars int")
    b = spark.createDataFrame([*items, (None, items[0][1]), (None, docs[1]), (5, None), (5, docs[2])], "item_id long, text string")
    alive, most, real = set(), [], dc.Windows.of

    def of(*a):
        alive.add(len(most))
        most.append(len(alive))
        return real(*a)

    monkeypatch.setattr(dc.Windows, "of", staticmethod(of))
    from pyspark.core.broadcast import Broadcast

    gone = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (alive and alive.pop(), gone(self, *a))[1])
    few = sorted(map(str, dc.passages(d, b, 5, block_words=10).collect()))
    assert len(most) > 3 and max(most) == 1
    cut = sorted(map(str, dc.clean(d, b, 5, block_words=10).collect()))
    monkeypatch.undo()
    assert few == sorted(map(str, dc.passages(d, b, 5).collect())) and any("end=" in r for r in few)
    assert cut == sorted(map(str, dc.clean(d, b, 5).collect()))
    assert dc.clean(d, b, 5, block_words=10).columns == d.columns
