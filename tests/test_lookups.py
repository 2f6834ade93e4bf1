import math
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import pii, vectors
from tessera.operators import chunking as ch
from tessera.operators import lookups as lk
from tessera.operators import policy as po


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_policies(spark):
    text = "a@b.de nr 4711 of DE44500105175407324931 at https://x.y/?token=abc&pwd=d&pass=e"
    got = {p: one(spark, text, lambda c, p=p: pii.mask_by_policy(c, p)) for p in ("strict", "balanced", "lenient", "other")}
    assert got["lenient"] == text.replace("a@b.de", "[REDACTED_EMAIL]")
    assert got["balanced"] == got["lenient"].replace("token=abc&pwd=d", "token=[REDACTED]&pwd=[REDACTED]")
    assert got["strict"] == got["balanced"].replace("pass=e", "pass=[REDACTED]").replace("nr 4711", "nr [REDACTED_NUMBER]").replace("DE44500105175407324931", "[REDACTED_IBAN]")
    assert got["other"] == got["balanced"]


def test_scope(spark):
    rows = [("t", "c", "t", "c"), ("t", None, "t", "c"), ("u", "c", "t", None), (None, None, "t", None), ("t", "c", None, "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "tenant string, case string, asked_tenant string, asked_case string")
    got = [r[0] for r in df.select(lk.scope_reasons(*map(F.col, df.columns))).collect()]
    assert got == [[], ["case_missing"], ["tenant_mismatch"], ["tenant_missing"], ["unknown"], []]


def test_parents(spark):
    docs = spark.createDataFrame([("t", "d", {"p": "äöü", "q": "abc", "r": None})], "tenant_id string, document string, parents map<string, string>")
    asked = spark.createDataFrame([("t", "d", " p "), ("t", "d", "p"), ("t", "d", "q"), ("t", "d", ""), ("t", "d", "none"), ("t", "e", "q"), ("t", "d", None), ("u", "d", "r"), (None, "d", "p")], "tenant_id string, document string, parent_id string")
    got = {r.parent_id: (r.content, r.content_bytes, r.truncated) for r in lk.parent_context(docs, asked, 3).collect()}
    assert got == {"p": ("ä", 6, True), "q": ("abc", 3, False)}
    assert lk.parent_context(docs, asked).where("parent_id = 'p'").first().content == "äöü"


def windows(sentences, target, least, overlap, size):
    """The rule sentence by sentence, without shared parts of the operator."""

    def cosine(a, b):
        va, vb = ([sum(zlib.crc32(w.encode()) % 64 == k for w in re.findall(r"\w+", " ".join(x).lower())) for k in range(64)] for x in (a, b))
        bottom = math.hypot(*va) * math.hypot(*vb)
        return sum(x * y for x, y in zip(va, vb)) / bottom if bottom else 0.0

    numbers = [int(m[1]) if (m := re.match(r"\s*(\d+)[.)]\s+", s)) else None for s in sentences]
    out, start, n = [], 0, 0
    for i, s in enumerate(sentences):
        n += len(s) // 4
        a = b = i
        while a > 0 and numbers[a] is not None and numbers[a - 1] == numbers[a] - 1:
            a -= 1
        while b + 1 < len(sentences) and numbers[b] is not None and numbers[b + 1] == numbers[b] + 1:
            b += 1
        whole = sum(len(x) // 4 for x in sentences[a : b + 1])
        if n < target or (i < b and whole <= target):
            continue
        out.append([*range(start, i + 1)])
        far = i + 1 < len(sentences) and cosine(sentences[i : i + size], sentences[i + 1 : i + 1 + size]) < least
        tail, m = [], 0
        if far or (i < b and whole > target):
            for j in range(i, start - 1, -1):
                if m + len(sentences[j]) // 4 > overlap:
                    break
                tail, m = [j, *tail], m + len(sentences[j]) // 4
        start, n = (tail[0] if tail else i + 1), m
    return [*out, [*range(start, len(sentences))]] if start < len(sentences) else out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["1. one item here", "2. two", "3. three items are long enough", "red apples fall", "red apples fell far from trees", "blue boats", "", "x"]), max_size=25), st.integers(3, 12))
def test_window_chunks(sentences, target):
    got = ch.window_boundaries(sentences, target=target, overlap=4)
    assert got == windows(sentences, target, 0.7, 4, 3)
    assert sorted({i for g in got for i in g}) == list(range(len(sentences)))


def test_hybrid_and_sections(spark):
    text = "One. Two. Three."
    rows = [(1, text, "agentic", [2, 3]), (2, text, "agentic", [2]), (3, text, "late", [1, 3]), (4, text, None, None), (5, None, "late", None), (6, text, "agentic", [2, 1, 3])]
    got = [tuple(r) for r in ch.hybrid(spark.createDataFrame(rows, "doc_id long, text string, mode string, ends array<int>")).orderBy("doc_id", "ord").collect()]
    assert got == [(1, "agentic", False, 0, 2, "One. Two."), (1, "agentic", False, 1, 1, "Three.")] + [(d, "late", fell, 0, 3, text) for d, fell in ((2, True), (3, False), (4, False), (6, True))]
    assert ch.sections("a\n# A\nb\n### C\nc\n## D\n\n# E\ne") == [([], "a"), (["A"], "b"), (["A", "C"], "c"), (["E"], "e")]
    assert ch.sections(None) == ch.sections("# only") == []
    made = ch.by_section(spark.createDataFrame([(1, "# A\n" + "w " * 300 + "\n# B\nend."), (2, None)], "doc_id long, text string")).orderBy("ord").collect()
    assert [r.path for r in made][-1] == ["B"] and made[-1].text == "end." and all(r.path == ["A"] for r in made[:-1]) and len(made) > 2


def test_broadcasts_are_bounded(spark):
    """Beyond the bound: the same rows, nothing broadcast."""
    v = spark.range(60).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(7.0), (F.col("id") % 5).cast("double")).alias("v"))
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    small, large = vectors.top_k(q, v, 4), vectors.top_k(q, v, 4, broadcast_rows=3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and large.count() == 80
    assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString()
    items = spark.createDataFrame([(i, f"c{i % 3}", None, None, None, f"t{i % 2}") for i in range(12)], "id long, collection_id string, workflow_id string, process string, doc_class string, tenant string")
    rules = spark.createDataFrame([("c0", None, None, None, None, "a"), (None, None, None, None, "t1", "b"), ("c0", None, None, None, "t1", "c"), ("c2", None, None, None, None, "d"), ("c2", None, None, None, None, "e")], "collection_id string, workflow_id string, process string, doc_class string, tenant string, profile string")
    small, large = po.routed(items, rules, "z"), po.routed(items, rules, "z", broadcast_rows=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and large.count() == 12
