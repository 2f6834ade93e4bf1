"""Scores of queries in blocks against brute force, and what a task keeps."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import scored as sd
from tessera.operators import scoped as sc


@pytest.mark.parametrize(("kind", "most"), [("long", 4), ("string", 4), ("long", None)])
@pytest.mark.parametrize("similarity", [True, False])
def test_terms(spark, kind, most, similarity):
    r = random.Random(3)
    key = (lambda i: i) if kind == "long" else (lambda i: f"k{i:03}")
    asked = [(k, f"g{k % 2}", k % 3, sorted(set(r.choices("abcdefgh", k=4))), 0.3) for k in range(11)]
    held = [(key(i), f"g{i % 3}", r.sample(range(3), r.randint(1, 2)), (lambda t: sorted(set(t)) if similarity else t)(r.choices("abcdefghij", k=r.randint(0, 9)))) for i in range(60)]
    want = {}
    for no, g, s, terms, least in asked:
        for i, h, seen, have in held:
            both = sum(t in terms for t in have)
            score = round(both / (len(terms) + len(have) - both), 6) if similarity and both else both
            if g == h and s in seen and both and (not similarity or score >= least):
                want.setdefault(no, []).append((-score, i))
    q = spark.createDataFrame(asked, "no long, grp string, scope long, terms array<string>, at_least double")
    h = spark.createDataFrame(held, f"id {kind}, grp string, seen array<long>, terms array<string>").repartition(3)
    got: dict = {}
    for x in sd.by_terms(q, h, most, similarity, rows=3).collect():
        got.setdefault(x.no, []).append((x.cost, x.id))
    assert {k: sorted(v)[:most] for k, v in got.items()} == {k: sorted(v)[:most] for k, v in want.items()}


def test_vectors(spark):
    r = np.random.default_rng(1)
    unit = lambda n: (lambda v: v / np.linalg.norm(v))(r.normal(size=n)).tolist()
    asked, held = [(k, None, k % 2, unit(3 + k % 2)) for k in range(9)], [(i, "g", [i % 2], unit(3 + i % 3)) for i in range(40)]
    asked = [(k, "g", s, u) for k, _, s, u in asked]
    q, h = spark.createDataFrame(asked, "no long, grp string, scope long, unit array<double>"), spark.createDataFrame(held, "id long, grp string, seen array<long>, unit array<double>")
    got = sorted((x.no, x.cost, x.id) for x in sd.by_vectors(q, h.coalesce(1), 2, rows=4).collect())
    pairs = [(k, round(1 - float(np.dot(u, v)), 6), i) for k, _, s, u in asked for i, _, seen, v in held if s in seen and len(u) == len(v)]
    assert got == sorted(p for k in range(9) for p in sorted(x for x in pairs if x[0] == k)[:2])


def test_a_task_holds_the_best_only():
    best = sd.Best(2, 3, pa.int64())
    best.room = 10
    for lo in range(0, 5000, 50):  # one large group of equal costs
        best.add(np.zeros(50, int), np.full(50, 0.5), pa.array(range(5000 - lo, 4950 - lo, -1)), np.arange(50))
        assert best.held <= 60
    assert best.prune()[2].to_pylist() == [1, 2, 3]


def test_of_many_alike_a_few_leave_the_tasks(spark):
    c = spark.createDataFrame([(i, "alpha beta", "t") for i in range(3000)], "id long, text string, tenant_id string").repartition(2)
    q = spark.createDataFrame([(k, "alpha beta", "t", 0.3) for k in range(5)], "query_id long, q string, tenant_id string, at_least double")
    asked, held = sc.prepared(q, c)
    found = sc.similar(asked, held, sc.seen(), 4)
    assert found.count() < 500 and {r.id for r in found.orderBy("query_id", F.desc("similarity"), "id").limit(4).collect()} == {0, 1, 2, 3}
