import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_files as tf
from tessera.llm.shared import WORD_MODEL

ODD = ["", None, " ", "Hello  World\n\nx", "It's I'LL we'd", "a\x1cb\x85c d　e", "<|startoftext|> x <|endoftext|>y", "Ende. <|STARTOFTEXT|> X. <|EndOfText|>.", "Größe! Ça va? Ok.\tNo.", "é é ́x", "ΑΣ Σ", "日本語 😀", "word " * 4000, "a" * 3000, "Hello  World\n\nx"]


def ids(text):
    return tf.word_table(WORD_MODEL).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB '\n.,Éßſǅİ²ªs\x1ćé日<|>1t!?\u0958\u095c\u09dc\u0a33\u0b5c\u0f43\ufb1d\ufb2a\u0344\u2126\u212b\u0307\u093c가"), max_size=30))
def test_words_give_the_ids_of_the_text(text):
    assert np.frombuffer(tf.word_table(WORD_MODEL).serialized(text, 1), "<u2").tolist() == ids(text)


def test_round_trip(spark):
    rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", tf.F.lit("clash"))
    files = tf.write_tokens(df, container_bytes=300)
    got = tf.read_tokens(files).collect()
    with_ids = {(r.doc_id, r.start): r.ids for r in tf.read_tokens(files, with_ids=True).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(got, key=lambda r: r.start)
    at = 0
    for (doc_id, text), r in zip(want, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids(text)))
        assert r.ids_crc32 == zlib.crc32(np.array(ids(text), "<u4").tobytes())
        assert with_ids[doc_id, at] == ids(text)
        at += r.n_tokens
    content = files.containers.first().content
    with pytest.raises(ValueError):
        tf.index(content, b"another dictionary")
    assert tf.token_files_digest(df.limit(0)).count() == 0


def test_words_of_documents():
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert np.frombuffer(tf.word_table(WORD_MODEL).serialized(text, 1), "<u2").tolist() == ids(text)


def test_letters_that_the_normalizer_takes_apart():
    for word in ("İ.", "\u0958.", "ab\u0958!", "\ufb1d.", "a\u0307?", "\u0344;", "é.", "9,"):
        assert np.frombuffer(tf.word_table(WORD_MODEL).serialized(word, 1), "<u2").tolist() == ids(word), word


def test_the_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"text {i} of no id " * 3) for i in range(500)] + [(7, "same row")] * 500 + [(i, "word " * 30_000) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files = tf.write_tokens(df, sample_docs=20)
    got = tf.read_tokens(files, with_ids=True).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 500
    assert sorted(r.n_tokens for r in got)[-1] > 30_000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(sorted(got, key=lambda r: r.start), sorted(got, key=lambda r: r.start)[1:]))


def test_marks_at_words_ends_are_words_of_their_own():
    """Runs of marks add no form of a word to the table, and any run in any place gives the library's ids."""
    table = tf.WordTable(WORD_MODEL)
    text = "Alpha$$$ alpha*** alpha%. Alpha!? alpha&&&\nalpha### alpha"
    assert np.frombuffer(table.serialized(text, 1), "<u2").tolist() == ids(text)
    assert sum("alpha" in word for word in table) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9é '\n\t.,!$#&%*@-<|>ćΣ̇²"), max_size=24))
def test_runs_of_marks_give_the_ids_of_the_text(text):
    assert np.frombuffer(tf.word_table(WORD_MODEL).serialized(text, 1), "<u2").tolist() == ids(text)
