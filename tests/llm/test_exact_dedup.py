import hashlib
import random
import re

import pytest

from tessera.llm import exact_dedup as ed

WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault((text or "").translate(WHITE), []).append(i)
    out = []
    for norm, at in groups.items():
        order = sorted(at, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        keep = rows[order[0]][0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        top = (len(rows[order[0]][1] or ""), keep)
        firsts = [i for i in order if (len(rows[i][1] or ""), rows[i][0]) == top]
        out += [(rows[i][0], keep, len(at), i == firsts[0], sha) for i in at]
    return sorted(out, key=str)


def check(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, place int").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_classes(df, **limits).collect()), key=str)
    assert got == brute(rows)


def made():
    r = random.Random(3)
    rows = [(i, r.choice(["a b", "ab ", " a\tb\n", "b", "B", "x" * 60 + str(i % 9), "x" * 60 + " " + str(i % 9), "é😀", "é ", "same text " * 40])) for i in range(300)]
    return [*rows, (None, "ab"), (None, None), (None, "new"), (301, None), (302, ""), (303, " \r\x0b\x0c"), (304, "long " * 60_000), (305, "long" * 60_000), (5, rows[5][1]), (5, rows[5][1]), (306, "a b"), (307, "\x00a")]


@pytest.mark.parametrize("limits", [{}, {"even": 1}, {"even": 7, "head": 2}, {"even": 10**6}])
def test_against_brute_force(spark, limits):
    check(spark, made(), **limits)


def test_a_text_with_nearly_all_rows_has_many_runs(spark):
    rows = [(i, "hot text" + " " * (i % 5)) for i in range(2000)] + [(7, "hot text")] * 500 + [(i, str(i)) for i in range(2000, 2200)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, sliced = ed.runs(df, even=100)
    assert sliced and placed.where("slice >= 0 and place = 1").count() > 20
    assert placed.agg({"run_size": "max"}).first()[0] < 800
    assert ed.deduplicated(df).count() == 201


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: ed.F.lit(42).cast("long"))
    check(spark, made(), head=1)
    check(spark, made(), head=1, even=3)


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_classes(df).count() == 0
    plan = ed.exact_classes(spark.range(100).selectExpr("id AS doc_id", "repeat('a', int(id % 9)) AS text"), even=10**6)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|MapIn", plan.replace("applySchemaToPythonRDD", "")) and "hashpartitioning" not in plan and plan.count("rangepartitioning") == 1
