import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_middle as fm

UNIT = {fm.code_points: lambda t: list(t), fm.words: lambda t: [x for x in re.split(r"(?<=[ \t\n\x0b\x0c\r])(?=[^ \t\n\x0b\x0c\r])", t) if x]}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\té日😀́<PSM>"), max_size=60), st.integers(1, 9), st.integers(1, 12), st.sampled_from(list(UNIT)))
def test_index_and_offsets(text, every, block, units):
    data = np.frombuffer(text.encode(), np.uint8)
    ix = fm.index(data, every, units, block)
    parts = UNIT[units](text)
    assert (ix.n_units, ix.n_chars) == (len(parts), len(text))
    assert list(ix.unit) == list(range(0, len(parts), every))
    for u in range(len(parts) + 1):
        head = "".join(parts[:u])
        assert fm.offset(data, ix, u, units) == (len(head.encode()), len(head))


def plainly(doc_id, text, plain=10, spm=20):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not t or any(m in t for m in fm.MARKS) or h[2] % 100 >= 100 - plain:
        return doc_id, len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(t), form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


TEXTS = ["", None, "a", "é", "<P>", "x<S>y", "<", "<<P", "ab<", "P>S>M><", "日本語😀" * 50, "\n\n", "long é " * 40_000, "\x00a", "<M", "same", "same"]


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, form string, n int")
    want = sorted((plainly(*r) for r in rows), key=str)
    got = fm.examples(df, **how)
    assert sorted(map(tuple, got.collect()), key=str) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = {}
    for d, t in rows:
        text.setdefault(d, []).append(sha(t or ""))
    for r in fm.digests(got).collect():
        assert r.restored_sha256 in text[r.doc_id]


def test_frames(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (None, "another"), (3, "é"), (3, "é")] + [(100 + i, "<<P<S<M words of text " * (i % 4) + "<" * (i % 3)) for i in range(200)]
    check(spark, rows)
    check(spark, rows, every=3, batch_bytes=50)
    assert fm.examples(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forms_are_shared_out(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 5) AS text")
    n = {r.form: r["count"] for r in fm.examples(df).groupBy("form").count().collect()}
    assert 200 < n["plain"] < 400 and 430 < n["spm"] < 650 and sum(n.values()) == 3000


def test_words_cut_between_words(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "'two words and then some more é' AS text")
    for r in fm.examples(df, plain=0, spm=0, units=fm.words).collect():
        p = "two words and then some more é"[: r.prefix_chars]
        assert r.n == 7 and (not p or p.endswith(" ") or len(p) == 30)
