import hashlib
import random
import re

from tessera.llm import spotsigs as ss


def plain_signatures(text, chain=3):
    items, run = [], ""
    for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()):
        if w in ss.ANCHORS:
            run += w + ">"
        elif w:
            items.append((run, w))
            run = ""
    if run:
        items.append((run, ""))
    words = [w for _, w in items]
    chains = [(r, *words[k : k + chain]) for k, (r, _) in enumerate(items)]
    return {c for c in chains if c[0]} or set(chains) or {text or ""}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "and", "der", "la"] * 3 + ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]
    return [*made, None, "", "...", "...", "the", "the of", "THE cat,sat", "xyzzy plugh", made[0], made[1] + " end", "日本語 and more"]


def test_neighbours_edits_and_likeness(spark):
    rows = [(3 * i, t, "k") for i, t in enumerate(texts(1, 40))] + [(None, "no id of the row", "k"), (6, "the same id", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = ss.edited_and_next(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    assert len(got) == len(rows)
    order = sorted([r for r in rows if r[0] != 6], key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    by_id = {r.doc_id: r for r in got}
    for i, (d, text, _) in enumerate(order):
        if d in (6, 9):
            continue
        t, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        r = by_id[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(plain_signatures(t), plain_signatures(edited))) < 1e-12
        assert abs(r.near_next - jaccard(plain_signatures(t), plain_signatures(following))) < 1e-12
    prints = {}
    for d, t, _ in rows:
        if d != 6:
            prints.setdefault(t or "", set()).add(by_id[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert ss.edited_and_next(df.limit(0)).count() == 0
    assert ss.edited_and_next(df.where("doc_id = 3")).collect()[0].near_next == 1


def test_similar_pairs(spark):
    base = texts(2, 12)
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, (t or "") + " tail of words") for i, t in enumerate(base)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.8, 0.4):
        pairs, members = ss.similar_pairs(df, threshold)
        rep = {r.doc_id: r.representative for r in members.collect()}
        found = {frozenset((r.a, r.b)): r.likeness for r in pairs.collect()}
        text = dict(docs)
        sets = {d: plain_signatures(t) for d, t in docs}
        for a in {*rep.values()}:
            for b in {*rep.values()}:
                if a < b:
                    want = jaccard(sets[a], sets[b])
                    assert (want >= threshold) == (frozenset((a, b)) in found), (a, b, text[a], text[b])
