"""Context around matches and the retrieval loop against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import context as cx
from tessera.operators import retrieval as re_
from tessera.operators import search as se


def made(r, queries=25):
    rows = []
    for q in range(queries):
        for i in range(r.randint(0, 12)):
            text = r.choice(["", "Title:", "Is it? ", "short one", "word " * r.randint(1, 60), "  \n "])
            rows.append((q, i, r.choice([None, 1, 2]), r.choice([["a"], ["a", "b"], ["c"]]), r.choice([None, *range(5)]), r.choice([0.5, 0.7, 0.9]), text, r.choice(range(12)) * 100 + i))
    return rows


SCHEMA = "query_id long, id long, doc long, section array<string>, ord long, score double, text string, n long"


def neighbours(rows, key, order):
    groups = {}
    for x in rows:
        if x["doc"] is not None:
            groups.setdefault(key(x), []).append(x)
    out = {}
    for g in groups.values():
        g.sort(key=order)
        for a, b in zip(g, g[1:]):
            out.setdefault(a["id"], []).append(b)
            out.setdefault(b["id"], []).insert(0, a)
    return out


def by_query(rows):
    names = ["query_id", "id", "doc", "section", "ord", "score", "text", "n"]
    out = {}
    for row in rows:
        x = dict(zip(names, row, strict=True))
        x["tokens"] = max(1, len(x["text"]) // 4) if x["text"] else 0
        out.setdefault(x["query_id"], []).append(x)
    return out


def walked(rows):
    """The order of one query's snippets, step by step."""
    beside = neighbours(rows, lambda x: (x["doc"], tuple(x["section"])), lambda x: (x["ord"] is None, x["ord"] or 0, x["id"]))
    in_doc = neighbours(rows, lambda x: x["doc"], lambda x: (x["n"], x["id"]))
    used, out = set(), []
    for x in sorted(rows, key=lambda x: (-x["score"], x["id"])):
        if x["id"] in used:
            continue
        more = sorted(beside.get(x["id"], []), key=lambda y: y["n"])
        t = x["text"].strip()
        if t and len(t) <= 220 and "?" not in t and len(t.split()) <= 30 and (t.endswith(":") or len(x["section"]) <= 1 and len(t.split()) <= 20):
            more += in_doc.get(x["id"], [])
        for y in [x, *more]:
            if y["id"] not in used:
                used.add(y["id"])
                out.append(y)
    return out


def test_expansion_and_budget(spark):
    rows = made(random.Random(4))
    df, per = spark.createDataFrame(rows, SCHEMA), by_query(rows)
    got = {}
    for r in cx.expanded(df).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [x["id"] for x in walked(xs)] for q, xs in per.items()}
    lead = {q: 1 for q in per if q % 2}
    want = {}
    for q, xs in per.items():
        order = walked(xs)
        if q in lead:
            order = sorted((x for x in order if x["doc"] == 1), key=lambda x: x["ord"] or 0) + [x for x in order if x["doc"] != 1]
        left = 40
        for x in order:
            if not x["tokens"]:
                continue
            if x["tokens"] > left:
                break
            left -= x["tokens"]
            want.setdefault(q, []).append((x["id"], 40 - left))
    got = {}
    primary = spark.createDataFrame(list(lead.items()), "query_id long, doc long")
    for r in cx.within_budget(df, 40, primary).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.used_tokens))
    assert got == want


def test_passages(spark):
    rows = made(random.Random(9))
    df, want = spark.createDataFrame(rows, SCHEMA), set()
    for q, xs in by_query(rows).items():
        beside = neighbours(xs, lambda x: (x["doc"], tuple(x["section"])), lambda x: (x["ord"] is None, x["ord"] or 0, x["id"]))
        used = set()
        for x in sorted(xs, key=lambda x: (-x["score"], x["id"])):
            if x["id"] in used:
                continue
            used.add(x["id"])
            took, left = [x], 30 - x["tokens"]
            for y in sorted((y for y in beside.get(x["id"], []) if y["id"] not in used), key=lambda y: y["n"]):
                if left > 0 and y["tokens"] <= left:
                    took.append(y)
                    used.add(y["id"])
                    left -= y["tokens"]
            took.sort(key=lambda y: y["n"])
            text = "\n\n".join(y["text"] for y in took).strip()
            if text:
                want.add((q, x["id"], tuple(y["id"] for y in took), text, max(y["score"] for y in took)))
    tokens = F.when(F.col("text") != "", F.greatest(F.lit(1), F.floor(F.length("text") / 4))).otherwise(0)
    got = cx.passages(df.withColumn("tokens", tokens), 30).collect()
    assert {(r.query_id, r.passage_id, tuple(r.ids), r.text, r.score) for r in got} == want
    assert cx.passages(df.limit(0).withColumn("tokens", tokens)).count() == 0


def test_a_pool_bounds_what_is_gathered(spark):
    df = spark.range(1000).selectExpr("1L AS query_id", "id", "1L AS doc", "array('a') AS section", "id AS ord", "1.0 / (1 + id) AS score", "'some text?' AS text", "id AS n")
    assert sorted(r.id for r in cx.expanded(df, pool=10).collect()) == list(range(10))


def test_variants(spark):
    df = spark.createDataFrame([("What is  it ",), ("x Overview",), (" ",), (None,)], "q string")
    got = [(r.a, r.b) for r in df.select(re_.variants(F.col("q")).alias("a"), re_.variants(F.col("q"), True).alias("b")).collect()]
    assert got[0] == (["What is  it", "What is  it overview", "What is  it key facts"], ["What is  it", "What is  it overview", "What is  it key facts", "What is  it background", "What is  it general principles"])
    assert got[2] == ([], []) and got[3] == ([], [])
    d = spark.createDataFrame([(["b0", " B0 ", "", "a1", None and "", "a1 "],)], "t array<string>").select(re_.distinct_texts(F.array_compact("t"), 9).alias("t"))
    assert d.first().t == ["b0", "a1"]


def test_sentences_keep_their_digits(spark):
    df = spark.createDataFrame([("0 first. Second 1! 2 third 2? 3 is 3",)], "t string")
    assert df.select(tx.simple_sentences(F.col("t"))).first()[0] == ["0 first.", "Second 1!", "2 third 2?", "3 is 3"]


def test_rounds(spark):
    """A sure query leaves after the first round; a weak one is asked again with a lower cutoff and more variants."""
    texts = ["alpha alpha alpha", "alpha", "beta", "gamma background", "delta"]
    c = spark.createDataFrame([(i, t, "t", [1.0, float(i)]) for i, t in enumerate(texts)], "id long, text string, tenant_id string, v array<double>")
    q = spark.createDataFrame([(1, "alpha", "t", None), (2, "nothing here", "t", None), (3, "  ", "t", None)], "query_id long, q string, tenant_id string, v array<double>")
    got = re_.retrieve(q, c, se.HybridParams())
    conduct = {(r.query_id, r.round): r.again for r in got.conduct.collect()}
    assert conduct == {(1, 0): True, (2, 0): True, (3, 0): True, (1, 1): False, (2, 1): False, (3, 1): False}
    rows = {(r.query_id, r.id): (r.variants, r.round) for r in got.matches.collect()}
    assert rows[1, 0] == ([0, 1, 2, 3, 4], 1) and rows[2, 3] == ([3], 1)  # the word `background` comes with the second round
    one = re_.retrieve(q, c, se.HybridParams(), retries=0)
    assert {r.round for r in one.matches.collect()} == {0} and one.conduct.where("again").isEmpty()
