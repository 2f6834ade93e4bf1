"""A batch of texts isn't held as Python strings at once."""

import tracemalloc

import pyarrow as pa

from tessera.llm import simhash


def test_fingerprints_hold_one_text_at_a_time():
    texts = [f"{k} " + "words of a text " * 1500 for k in range(600)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    want = [simhash.fingerprint(texts[k]) for k in (0, 600, 601)]
    del texts
    list(simhash.fingerprinted(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    (made,) = simhash.fingerprinted(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fps = made.column("fp").to_pylist()
    assert [fps[k] % (1 << 64) for k in (0, 600, 601)] == want and made.schema.names == ["doc_id", "fp"]
    assert peak < 6_000_000 < batch.nbytes
