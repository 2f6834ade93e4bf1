import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "x   ", "▁", "a▁ b", "\n", "a\nb c\t d", "é́ ﬁ①", "\x00 q", "<s> </s> <unk>", "日本語 テキスト 😀", "a" * 5000, "the " * 3000]


def check(text):
    sp = pieces.processor(pieces.PIECE_MODEL)
    ids = sp.encode(text or "")
    assert pieces.encode(text) == ids
    assert pieces.count_tokens(text) == len(ids)
    assert " ".join(d for _, _, d in pieces.id_table(pieces.PIECE_MODEL).of(text)) == sp.decode(ids)


def test_odd_texts():
    for t in [*ODD, None]:
        check(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e\n ▁.é日😀\t0́"), max_size=40))
def test_any_text(text):
    check(text)


def test_generations_do_not_change_results():
    table = pieces.ChunkTable(pieces.PIECE_MODEL, lambda sp, ids: ids, generation=3)
    words = [random.Random(1).choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(i % 7) for i in range(200)]
    sp = pieces.processor(pieces.PIECE_MODEL)
    assert [i for ids in table.of(" ".join(words)) for i in ids] == sp.encode(" ".join(words))
    assert len(table) <= 3


def test_frames(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None, "a b"])], "doc_id long, text string, n_tokens string")
    sp = pieces.processor(pieces.PIECE_MODEL)
    counts = {r.doc_id: r for r in pieces.token_counts(df, limit=5).collect()}
    digests = {r.doc_id: r for r in pieces.encoded_digests(df).collect()}
    full = {r.doc_id: r for r in pieces.encoded(df).collect()}
    for i, t in enumerate([*ODD, None, "a b"]):
        ids = sp.encode(t or "")
        assert (counts[i].n_tokens, counts[i].over_limit, counts[i].n_bytes) == (len(ids), len(ids) > 5, len((t or "").encode()))
        assert full[i].ids == ids and full[i].decoded == sp.decode(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.token_counts(df.limit(0)).count() == 0
