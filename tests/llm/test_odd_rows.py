"""Rows that the other tests leave out: null and repeated ids, repeated rows, very long texts."""

import hashlib
import zlib
from collections import Counter

from tessera.llm import pieces, sharding, simhash, spotsigs

LONG = "many different words " * 20_000 + "end"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tokens_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "c"), (1, "a b"), (1, "a b"), (1, "other"), (2, None), (3, LONG)]
    sp = pieces.processor(pieces.PIECE_MODEL)
    n = lambda t: len(sp.encode(t or ""))
    counts = Counter((r.doc_id, r.n_tokens, r.over_limit) for r in pieces.token_counts(frame(spark, rows)).collect())
    assert counts == Counter((i, n(t), n(t) > 4096) for i, t in rows)
    digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in pieces.encoded_digests(frame(spark, rows)).collect())
    assert digests == Counter((i, n(t), hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest()) for i, t in rows)


def test_shards_of_very_long_texts(spark):
    rows = [(i, LONG if i == 3 else f"text {i % 40}") for i in range(400)] + [(None, "no id"), (5, "text 5"), (5, "text 5")]
    got = sharding.shards_by_bytes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    assert len({r.shard for r in got if r.size == len(LONG) + 1}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_fingerprints_of_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(None, base), (7, base), (9, base + " x"), (None, "only null ids have this text here"), (None, "only null ids have this text here"), (4, LONG), (None, None), (11, "")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.fingerprint, []).append((r.doc_id, r.component_id))
    assert sorted(of["0" * 16], key=str) == [(11, 11), (None, 11)]
    assert {c for i, c in sum(of.values(), []) if i in (7, 9)} == {7} and (None, 7) in sum(of.values(), [])
    assert (None, None) in sum(of.values(), [])


def test_likeness_of_repeated_ids_and_very_long_texts(spark):
    rows = [(1, "the cat is on a mat and the dog is in the house " * 5), (2, LONG), (2, LONG), (3, None), (None, "the end is near"), (4, "")]
    got = spotsigs.edited_and_next(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1 and all(r.n_chars == len(LONG) for r in got if r.doc_id == 2)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
