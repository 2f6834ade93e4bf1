import hashlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment as al

A, B = al.BYTE_MODEL, al.PIECE_MODEL
ODD = "ab e\n\t\r\x0b\x0c\x85\xa0\u1680\u2003\u2028\u3000\x1c\u200b.'s1é日😀\u0301\0<|endoftext|>"


def tokens(text):
    """ids and byte ends of the whole text by both libraries; none if the joined bytes differ."""
    both = al.pair(A, B)
    if not text:
        return None
    x, y = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.a_bytes[i] for i in x) != raw or b"".join(both.b_bytes[i] for i in y) != raw:
        return None
    return x, y


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at = out[-1][1]
    return out


def brute(rows):
    """All documents by the definition: every pair of ranges is held against each other within groups."""
    both, made, count = al.pair(A, B), [], Counter()
    for doc_id, text in rows:
        found = tokens(text)
        if not found:
            made.append((doc_id, None))
            continue
        x, y = spans(found[0], both.a_bytes), spans(found[1], both.b_bytes)
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, lo = [], 0
        for e in ends:
            groups.append(([s for s in x if lo <= s[0] and s[1] <= e], [s for s in y if lo <= s[0] and s[1] <= e]))
            lo = e
        links = [(p[2], q[2]) for g in groups for p in g[0] for q in g[1] if max(p[0], q[0]) < min(p[1], q[1])]
        count.update(links)
        made.append((doc_id, (x, y, groups, links)))
    best = defaultdict(int)
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = []
    for doc_id, m in made:
        if m is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = m
        text = ";".join(",".join(str(s[2]) for s in g) + "|" + ",".join(str(s[2]) for s in h) for g, h in groups)
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(ODD), max_size=40))
def test_segments_encode_as_the_whole(text):
    both = al.pair(A, B)
    if not text:
        return
    parts = both.split(text)
    assert "".join(parts) == " " + text
    a, b = both.encoded(parts)
    assert [i for x in a for i in x] == both.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for x in b for i in x] == both.b.encode(text)


def test_breaks_are_proven():
    both = al.pair(A, B)
    assert " " in both.safe and "\n" in both.safe and "\r" not in both.safe  # B has pieces such as ";\\r"
    assert both.split("a\r\nb\n c  d") == [" a\r\nb", "\n c", "  d"]
    assert both.split(None) == both.split("") == both.split("a▁b") == []


def rows():
    made = [(i, t) for i, t in enumerate(["", None, " ", "a", "▁", "x▁y", "the cat sat on the mat", "The  cat\n\nsat;\r\n", "日本語 テキスト 😀😀", "<|endoftext|> <s>", "it's 1234 o'clock", " ", "\n", "tail  ", "x" * 3000, "word " * 5000, "\0 a\0"])]
    made += [(None, "no id"), (None, "the no id"), (3, "a"), (3, "other text"), (6, "the cat sat on the mat")]
    return made + [(100 + i, " ".join(["unbelievably", "internationalisation", "antidisestablishment", "Überraschung", "naïve"][j % 5] + "abc"[: (i + j) % 4] for j in range(i % 17))) for i in range(120)]


def check(spark, made, **how):
    df = spark.createDataFrame([(*r, "x", 3) for r in made], "doc_id long, text string, segment string, block int").repartition(3)
    assert sorted(map(tuple, al.cross_alignment(df, **how).collect()), key=str) == brute(made)


def test_against_brute_force(spark):
    check(spark, rows())
    check(spark, rows(), block_chars=30)


def test_a_segment_of_all_texts(spark):
    check(spark, [(i, "hot " * (i % 7) + str(i % 11)) for i in range(400)], block_chars=100)


def test_empty_table(spark):
    assert al.cross_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "▁")])
