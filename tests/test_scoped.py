"""Scoped search: filters by hand, the trigram index and its fallback against brute force, filters in the scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import scoped as sc
from tessera.operators import search as se

SF = "/root/testdata/sf0.001"


def test_filter_spec_by_hand():
    spec = sc.FilterSpec.of({"tenant_id": " t1 ", "collection_ids": [" c2", "", "c1"], "case_id": "  ", "is_latest": False, "project": 7, "metadata": {"hash": "h", "is_latest": True}}, tenant_id="other", case_id="case")
    assert (spec.tenant_id, spec.case_id, spec.collection_ids) == ("t1", "case", ("c2", "c1"))
    assert spec.mapping() == {"collection_ids": ("c2", "c1"), "is_latest": False, "project": 7, "hash": "h"}
    assert sc.FilterSpec.of(None, tenant_id="t").scope()["is_latest"] == "true"
    assert sc.FilterSpec.of({"document_version_id": "v"}).scope()["is_latest"] is None
    assert sc.FilterSpec.of({"collection_ids": "one"}).collection_ids == ("one",)


def held(spark, rows):
    names = ["tenant_id", "lifecycle", "lifecycle_state", "is_latest", "hash", "metadata_hash", "case_id", "collection_id", "doc_class", *sc.METADATA.values()]
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} string" for n in names))


def test_constants_and_columns_agree(spark):
    r = random.Random(2)
    pick = lambda *x: r.choice([None, *x])
    rows = [dict(tenant_id=pick("a", "b"), lifecycle=pick("active", "deleted"), lifecycle_state=pick("active", "retired"), is_latest=pick("true", "false"), hash=pick("h1", "h2"), metadata_hash=pick("h1"), case_id=pick("k"), collection_id=pick("c1", "c2"), doc_class=pick("c1"), source=pick("s"), document_version_id=pick("v")) for _ in range(400)]
    df = held(spark, rows)
    specs = [{}, {"hash": "h1"}, {"case_id": "k"}, {"collection_ids": ["c1"]}, {"case_id": "k", "collection_id": "c2"}, {"is_latest": False, "source": "s"}, {"document_version_id": "v"}]

    def plainly(x, s, shown, routing):
        active = all(x.get(c) in (None, "active") for c in ("lifecycle", "lifecycle_state"))
        if x["tenant_id"] != "a" or not (shown == "all" or active == (shown == "active")):
            return False
        latest = str(s["is_latest"]).lower() if "is_latest" in s else None if "document_version_id" in s else "true"
        if latest and not (x["is_latest"] == latest or latest == "true" and x["is_latest"] is None):
            return False
        if "hash" in s and s["hash"] not in (x["hash"], x["metadata_hash"]) or "source" in s and x["source"] != s["source"] or "document_version_id" in s and x["document_version_id"] != "v":
            return False
        ids = s.get("collection_ids") or ([s["collection_id"]] if "collection_id" in s else [])
        arms = [x["case_id"] == s.get("case_id")] * ("case_id" in s) + [x["collection_id"] in ids or routing and x["doc_class"] in ids] * bool(ids)
        return not arms or any(arms)

    for s in specs:
        for shown in ("active", "deleted", "all"):
            for routing in (False, True):
                spec = sc.FilterSpec.of(s, tenant_id="a")
                want = [i for i, x in enumerate(rows) if plainly(x, s, shown, routing)]
                assert sorted(r.id for r in df.where(spec.predicate(shown, routing)).collect()) == want, (s, shown, routing)
                values = spec.scope(shown)
                asked = {k: F.lit(v) if v is not None else F.lit(None).cast("array<string>" if k == "collection_ids" else "string") for k, v in values.items()}
                assert sorted(r.id for r in df.where(sc.in_scope(asked, F.col, routing)).collect()) == want, (s, shown, routing)


def test_the_scan_gets_the_filters(spark):
    chunks = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tenant_id"), F.col("source").alias("lifecycle"))
    queries = spark.createDataFrame([(1, "the", "en"), (2, "und", "de")], "query_id long, q string, tenant_id string")
    q, c = sc.prepared(queries, chunks)
    plan = sc.word_leg(q, c, 5, sc.seen())._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\n]*)", plan)[1]
    assert "In(lang" in pushed and "EqualTo(source,active)" in pushed


def grams(text):
    return {("  " + w + " ")[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)}


def made(r, n):
    words = ["alpha", "alphas", "beta", "betas", "gamma", "delta", "deltas", "x", "xy", "zeta"]
    return [" ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(n)]


def frames(spark, texts, asked):
    c = spark.createDataFrame([(i, t, f"t{i % 2}") for i, t in enumerate(texts)], "id long, text string, tenant_id string")
    q = spark.createDataFrame([(i, t, f"t{i % 2}") for i, t in enumerate(asked)], "query_id long, q string, tenant_id string")
    return sc.prepared(q, c)


def likeness(texts, asked):
    out = {}
    for k, q in enumerate(asked):
        for i, t in enumerate(texts):
            a, b = grams(q), grams(t)
            if i % 2 == k % 2:
                out[k, i] = round(len(a & b) / len(a | b), 6) if a | b else 0.0
    return out


@pytest.mark.parametrize("at_least", [0.05, 0.3, 0.5, 0.75, 1.0])
def test_similar_against_brute_force(spark, at_least):
    r = random.Random(int(at_least * 100))
    texts, asked = [*made(r, 60), "", "unlike all others"], [*made(r, 20), "", "qqq vvv"]
    q, c = frames(spark, texts, asked)
    got = {(x.query_id, x.id): x.similarity for x in sc.similar(q.withColumn("at_least", F.lit(at_least)), c, sc.seen()).collect()}
    assert got == {k: s for k, s in likeness(texts, asked).items() if s >= at_least and grams(asked[k[0]])}


def test_limits_by_hand():
    assert sc.limits(None, 0.3) == ([0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.0], 0.05)
    assert sc.limits(0.4, 0.4) == ([0.4, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.0], 0.4)
    assert sc.limits(None, 0.02) == ([0.02, 0.08, 0.06, 0.05, 0.04, 0.03, 0.01, 0.0], 0.02)


@pytest.mark.parametrize(("requested", "limit"), [(None, 0.3), (0.6, 0.3), (None, 0.9)])
def test_fallback_against_the_search_by_steps(spark, requested, limit):
    r = random.Random(5)
    texts, asked = made(r, 40), [*made(r, 15), "qqq vvv", " ", "alp", "delta omega sigma tau"]
    like = likeness(texts, asked)
    first = limit if requested is None else requested
    want = {}
    for k, text in enumerate(asked):
        rows = {i: s for (q, i), s in like.items() if q == k}
        if not text.strip():
            continue
        hit, used = {i: s for i, s in rows.items() if s >= first}, None
        if not hit:
            tried, floor = sc.limits(requested, limit)
            for x in tried:  # as the steps of the search read: the last that finds something, or the first at the floor
                got = {i: s for i, s in rows.items() if s >= x}
                if got:
                    hit, used = got, x
                    if x <= floor + 1e-9:
                        break
        for rank, (i, s) in enumerate(sorted(hit.items(), key=lambda p: (-p[1], p[0]))[:7], 1):
            want[k, i] = (s, rank, used)
    got = {(x.query_id, x.id): (x.lscore, x.rank, x.fallback_limit) for x in sc.trigram_leg(*frames(spark, texts, asked), 7, sc.seen(), requested, limit).collect()}
    assert got == want and any(u == 0.0 for _, _, u in want.values()) and any(u is None for _, _, u in want.values())


def test_second_leg_only_if_needed(spark, monkeypatch):
    calls = []
    real = sc.similar
    monkeypatch.setattr(sc, "similar", lambda *a: calls.append(1) or real(*a))
    sc.trigram_leg(*frames(spark, ["alpha beta", "alpha beta"], ["alpha beta", "alpha"]), 5, sc.seen()).count()
    assert len(calls) == 1
    sc.trigram_leg(*frames(spark, ["alpha beta", "alpha beta"], ["alpha beta", "other"]), 5, sc.seen()).count()
    assert len(calls) == 3


def test_hybrid_by_trigrams_fills_up_after_a_fallback(spark):
    c = spark.createDataFrame([(i, t, [1.0, float(i)], "t") for i, t in enumerate(["alpha beta gamma", "alphabet soup", "unlike", "other"])], "id long, text string, v array<double>, tenant_id string")
    q = spark.createDataFrame([(1, "alpha beta gamma", [0.0, 0.0], "t"), (2, "alpine quartz", None, "t"), (3, "alpha", None, "none")], "query_id long, q string, v array<double>, tenant_id string")
    found = sc.hybrid_search(q, c, se.HybridParams(min_sim=0.99), mode="trgm")
    hits, report = {(r.query_id, r.id): r for r in found.hits.collect()}, {r.query_id: r for r in found.report.collect()}
    assert not hits[1, 0].cutoff_fallback and {i for k, i in hits if k == 1} == {0}
    assert report[1].query_embedding_empty and report[1].vector_candidates == 0 and report[1].fallback_limit_used is None
    assert report[2].fallback_limit_used == 0.05 and hits[2, 1].rank == 1
    assert report[3].returned == 0 and report[3].fused_candidates == 0 and report[3].applied_trgm_limit == 0.3


def test_identifier(spark):
    u = "0A1b2c3d-0000-4000-8000-00000000000F"
    df = spark.createDataFrame([(x,) for x in (u, u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u.lower(), " " + u + " ", "x" + u[1:], "", None)], "c string")
    assert [r[0] for r in df.select(sc.identifier(F.col("c"))).collect()] == [u.lower()] * 5 + [None] * 3
