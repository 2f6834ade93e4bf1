import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking as ch
from tessera.operators import context as cx
from tessera.operators import dedup as dd
from tessera.operators import evaluate as ev
from tessera.operators import policy as po
from tessera.operators import rank as rk
from tessera.operators import search as se
from tessera.streaming import jobs


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_texts(spark):
    assert column(spark, ["Häuser  laufen", "rosen", "Alte", "ab en"], tx.normalise) == ["häuser lauf", "rose", "alte", "ab en"]
    assert column(spark, ["", "abc", "a" * 9], tx.tokens_quarter) == [0, 1, 2]
    assert column(spark, ["Beta alpha, BETA"], tx.dedup_tokens) == [["alpha", "beta"]]
    cuts = column(spark, ["aé" * 60, "日" * 50, "😀" * 40, "short"], lambda c: tx.truncate_bytes(c, 100))
    assert cuts == ["aé" * 33 + "a", "日" * 33, "😀" * 25, "short"]
    got = column(spark, ["See https://a.b/c.d now. It is 3.5 big. Dr. Who came! 1. item stays"], tx.sentences)[0]
    assert got == ["See https://a.b/c.d now.", "It is 3.5 big.", "Dr. Who came!", "1. item stays"] or len(got) >= 3


def test_fusion_bounds(spark):
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, id long, rank int")
    x = spark.createDataFrame([(1, 11, 1), (3, 12, 1)], "query_id long, id long, rank int")
    got = {(r.query_id, r.id): r.fused for r in se.fused(v, x, 0.7, 60).collect()}
    assert got[1, 10] == 0.7 and got[2, 10] == 1.0 and got[3, 12] == 1.0
    assert abs(got[1, 11] - (0.7 * 61 / 62 + 0.3)) < 1e-6 and all(0 <= s <= 1 for s in got.values())
    assert se.HybridParams(top_k=99, alpha=7.0, vec_limit=1).clamped() == se.HybridParams(top_k=10, alpha=1.0, vec_limit=10)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "z", 1)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "query_id long, id string")
    got = {r.query_id: r for r in ev.ranking_metrics(ranked, relevant, 3).collect()}
    assert got[1].recall == 1.0 and got[1].mrr == 1.0 and 0.9 < got[1].ndcg < 1 and got[2].recall == got[2].ndcg == 0


def test_mmr_and_passages(spark):
    rows = [(1, i, i % 2, 1.0 - i / 10, ["a", "b"] if i < 2 else [str(i)], "h") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id long, id long, doc long, score double, tokens array<string>, host string")
    assert [r.id for r in rk.mmr(df, 3, 0.5).orderBy("rank").collect()] == [0, 2, 3]
    chunks = spark.createDataFrame([(1, i, 1, "s", i, [0.2, 0.9, 0.3, 0.1][i], 40, i) for i in range(4)], "query_id long, id long, doc long, section string, ord long, score double, tokens int, n long")
    got = [(r.passage_id, r.ids) for r in cx.passages(chunks.withColumn("text", F.lit("t")), 90).orderBy(F.desc("score")).collect()]
    assert got == [(1, [0, 1]), (2, [2, 3])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_packing_covers_everything(sizes):
    sentences = [" ".join(["w"] * n) + "." for n in sizes]
    for groups in (ch.pack(sentences, 40, 10, 60), ch.late_boundaries(sentences, 40)):
        assert sorted({i for g in groups for i in g}) == list(range(len(sizes)))
        assert all(g == sorted(g) for g in groups)
    assert all(sum(sizes[i] for i in g) <= 60 for g in ch.pack(sentences, 40, 10, 60))


def test_jaccard_pairs_against_brute_force(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdefgh") + r.choice("xy") for _ in range(r.randint(1, 12)))) for i in range(80)]
    got = {(x.a, x.b) for x in dd.jaccard_pairs(spark.createDataFrame(docs, "id long, text string"), 0.6).collect()}
    first = {}
    for i, t in docs:
        first.setdefault(frozenset(re.findall(r"\w+", t)), i)
    sets = {i: s for s, i in first.items()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_policies(spark):
    df = spark.createDataFrame([("active", None), (None, "deleted"), ("retired", None)], "d string, c string")
    see = lambda *a: [r[0] for r in df.select(po.visible(F.col("d"), F.col("c"), *a)).collect()]
    assert see() == [True, False, False] and see("deleted") == [True, False, False] and see("deleted", True) == [False, True, True]
    lit = lambda x: F.lit(x).cast("double")
    one = spark.range(1)
    f = lambda *a: one.select(po.frontier(*a).alias("f")).first().f
    yes, no = F.lit(True), F.lit(False)
    assert f(yes, F.lit(0), yes, lit(None), lit(None), lit(None), lit(None), lit(100)).reason == "manual_retire"
    assert f(no, F.lit(5), yes, lit(None), lit(None), lit(None), lit(None), lit(100)).action == "retire"
    got = f(no, F.lit(3), yes, lit(90), lit(50), lit(20), lit(None), lit(100))
    assert (got.action, got.reason, got.at) == ("defer", "failure_backoff", 280.0)
    assert f(no, F.lit(0), yes, lit(None), lit(None), lit(None), lit(None), lit(100)).action == "enqueue"


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{i:02d}", ok) for i, ok in enumerate([True, False, False, False])] + [(2, "2024-01-01 00:00:00", True)]
    df = spark.createDataFrame(rows, "user_id long, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = jobs.read_events(spark, str(tmp_path / "e"), df.schema)
    got = {r.user_id: (r.state, r.failures) for r in jobs.run_available(jobs.breaker(stream), str(tmp_path / "out"), "update").collect()}
    assert got == {1: ("open", 3), 2: ("closed", 0)}


def test_values_by_hand(spark):
    """Results worked out from the definitions, not from the engine's own SQL."""
    from tessera.functions import pii

    def one(value, f):
        return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x

    assert one("Hello, world! (a-b)", tx.websearch) == "Hello OR world OR a OR b"
    assert one("...", tx.websearch) == "" and one("single", tx.websearch) == "single"
    assert one("Kosten  (kosten a/karten Autos Tische e\u0301t\u00e9s", tx.normalise) == "kost (kosten a/karten autos tisch \u00e9t\u00e9s"
    assert one("One sentence here. Two sentences there.\nshort", tx.key_points) == ["One sentence here.", "Two sentences there.", "One sentence here. Two sentences there."]
    assert one("tiny", tx.key_points) == ["tiny"] * 3 and one("", tx.key_points) == [""] * 3
    assert len(one(" ".join(f"Sentence number {i}." for i in range(9)), tx.key_points)) == 5
    assert one("see x?token=abc", pii.mask_url_params) == "see x?token=abc"
    assert one("https://h/p?a=1&token=abc&sid=2#f token=q", pii.mask_url_params) == "https://h/p?a=1&token=[REDACTED]&sid=[REDACTED]#f token=q"
    assert one("https://h/?key=short and https://h/?key=ABCDEFGHIJKLMNOPQRST1", pii.mask_url_params) == "https://h/?key=short and https://h/?key=[REDACTED]"
    assert one("order 12345 by a@b.org", pii.mask) == "order 12345 by [REDACTED_EMAIL]"
    assert one("order 12345", lambda c: pii.mask(c, numbers=True)) == "order [REDACTED_NUMBER]"


def test_members_of_equal_word_sets(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "c b a a"), (4, "other"), (5, "..."), (6, None)], "id long, text string")
    assert {tuple(r) for r in dd.jaccard_members(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
