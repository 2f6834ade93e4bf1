"""The commit log: writers in each other's way, writers that die, replays, claims."""

import threading

import pytest

from tessera.operators import upserts as up
from tessera.sources.commits import Change, Claims, InFlight, Taken


def rows(spark, data):
    """data: {key: (hash, [(chunk, version, text)])}"""
    d = spark.createDataFrame([(k, h) for k, (h, _) in data.items()], "key string, hash string")
    c = spark.createDataFrame([(i, k, v, True, t, "t1") for k, (_, cs) in data.items() for i, v, t in cs], "chunk_id string, key string, version string, is_latest boolean, text string, tenant_id string")
    e = spark.createDataFrame([(i, [float(len(t)), 1.0]) for _, (_, cs) in data.items() for i, _, t in cs], "chunk_id string, v array<double>")
    return d, c, e


def state(tables):
    got = {n: tables.table(n) for n in up.KEYS}
    return (
        {r.key: r.hash for r in got["documents"].collect()},
        {r.chunk_id: (r.key, r.version, r.is_latest, r.text) for r in got["chunks"].collect()},
        {r.chunk_id: r.v[0] for r in got["embeddings"].collect()},
    )


def test_upsert_replace_versions(spark, tmp_path):
    t = up.store(spark, str(tmp_path))
    assert t.table("documents") is None and t.commits() == []
    assert up.upsert(t, *rows(spark, {"a": ("h1", [("a1", "v1", "one"), ("a2", "v1", "two")]), "b": ("h2", [("b1", None, "bee")])})) == {"inserted": 2, "chunks": 3}
    assert up.upsert(t, *rows(spark, {"a": ("h1", [("a9", "v1", "never")])})) == {"skipped": 1, "chunks": 0}
    assert len(t.commits()) == 1
    assert up.upsert(t, *rows(spark, {"a": ("h3", [("a3", "v2", "three")]), "b": ("h4", [("b2", None, "wasp")]), "c": ("h2", [("c1", None, "c")])}))["replaced"] == 2
    docs, chunks, vecs = state(t)
    assert docs == {"a": "h3", "b": "h4", "c": "h2"}
    assert chunks == {"a1": ("a", "v1", False, "one"), "a2": ("a", "v1", False, "two"), "a3": ("a", "v2", True, "three"), "b2": ("b", None, True, "wasp"), "c1": ("c", None, True, "c")}
    assert vecs == {"a1": 3.0, "a2": 3.0, "a3": 5.0, "b2": 4.0, "c1": 1.0}
    up.upsert(t, *rows(spark, {"a": ("h5", [("a4", "v1", "again")])}))
    assert set(state(t)[1]) == {"a3", "a4", "b2", "c1"} and not state(t)[1]["a3"][2] and set(state(t)[2]) == {"a3", "a4", "b2", "c1"}
    assert {r.key: r.hash for r in t.table("documents", t.commits(1)).collect()} == {"a": "h1", "b": "h2"}
    before = state(t)
    t.compact()
    assert state(t) == before and len(t.commits()) == 1
    gone = t.vacuum(0)
    assert len(gone) == 3 and state(t) == before


def test_near_duplicates(spark, tmp_path):
    t = up.store(spark, str(tmp_path))
    up.upsert(t, *rows(spark, {"a": ("h1", [("a1", None, "one")]), "b": ("h2", [("b1", None, "two")])}))
    near = spark.createDataFrame([("x", "a", True), ("y", "b", False)], "key string, other string, replaces boolean")
    assert up.upsert(t, *rows(spark, {"x": ("h8", [("x1", None, "x")]), "y": ("h9", [("y1", None, "y")])}), near) == {"near_duplicate_replaced": 1, "near_duplicate_skipped": 1, "chunks": 1}
    assert set(state(t)[0]) == {"b", "x"} and set(state(t)[1]) == set(state(t)[2]) == {"b1", "x1"}


def test_writers_at_once_all_land(spark, tmp_path):
    t = up.store(spark, str(tmp_path))
    failed = []

    def write(k):
        try:
            up.upsert(up.store(spark, str(tmp_path)), *rows(spark, {f"k{k}": (f"h{k}", [(f"c{k}", None, "x" * k)]), "shared": (f"s{k}", [(f"s{k}", None, "y")])}), tries=8)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed
    docs, chunks, vecs = state(t)
    assert set(docs) == {"k1", "k2", "k3", "k4", "shared"}
    assert len(chunks) == len(vecs) == 5 and sum(c[0] == "shared" for c in chunks.values()) == 1  # the last writer's, whole
    assert [c.number for c in t.commits()] == [1, 2, 3, 4]


def test_a_lost_race_is_tried_again_and_given_up(spark, tmp_path):
    t, other = up.store(spark, str(tmp_path)), up.store(spark, str(tmp_path))
    asked = []

    def change(seen):
        asked.append(len(seen))
        up.upsert(other, *rows(spark, {f"o{len(asked)}": (f"h{len(asked)}", [(f"o{len(asked)}", None, "o")])}))
        return {"documents": Change(rows(spark, {"mine": ("m", [])})[0])}, {}

    with pytest.raises(Taken):
        t.transact(change, tries=3, wait=0)
    assert asked == [0, 1, 2] and set(state(t)[0]) == {"o1", "o2", "o3"} and len(t.data.names()) == 3


def test_a_killed_writer_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = up.store(spark, str(tmp_path))
    up.upsert(t, *rows(spark, {"a": ("h1", [("a1", None, "one")])}))
    before = state(t)
    monkeypatch.setattr(t.log, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        up.upsert(t, *rows(spark, {"a": ("h2", [("a2", None, "two")])}))
    assert state(up.store(spark, str(tmp_path))) == before
    # killed so hard that it couldn't clean up: its folder is named by no commit
    rows(spark, {"a": ("h3", [])})[0].write.parquet(f"{tmp_path}/data/{'0' * 32}/documents-add")
    assert state(t) == before and t.vacuum(0) == ["0" * 32]


def test_batches_once(spark, tmp_path):
    t = up.store(spark, str(tmp_path))
    write = t.each_batch_once("app", lambda batch, seen: {"documents": Change(batch)})
    one, two = rows(spark, {"a": ("h1", [])})[0], rows(spark, {"b": ("h2", [])})[0]
    write(one, 0)
    write(one, 0)
    write(two, 1)
    write(one, 0)
    assert sorted(r.key for r in t.table("documents").collect()) == ["a", "b"] and len(t.commits()) == 2
    t.compact()
    write(two, 1)
    assert t.table("documents").count() == 2 and t.marked("app", t.commits()) == 1


def test_a_stream_replayed_from_an_older_checkpoint(spark, tmp_path):
    t = up.store(spark, str(tmp_path / "t"))
    for k in range(3):
        spark.createDataFrame([(f"k{k}", f"h{k}")], "key string, hash string").write.parquet(str(tmp_path / f"in/{k}"))
    for place in ("c1", "c2"):  # the second query knows nothing of the first but the tables' marks
        stream = spark.readStream.schema("key string, hash string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = stream.writeStream.foreachBatch(t.each_batch_once("app", lambda b, seen: {"documents": Change(b)})).option("checkpointLocation", str(tmp_path / place)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.key for r in t.table("documents").collect()) == ["k0", "k1", "k2"]


def test_claims(spark, tmp_path):
    clock = [1000.0]
    claims = Claims(spark, str(tmp_path), ttl=100, now=lambda: clock[0])
    ran = []

    def inside():
        with pytest.raises(InFlight):
            claims.once("k", lambda: ran.append("never"))
        assert claims.status("k") == "inflight"
        return 7

    assert claims.once("k", inside) == 7 and claims.status("k") == "done"
    assert claims.once("k", lambda: ran.append("never"), "nothing") == "nothing" and not ran
    with pytest.raises(ZeroDivisionError):
        claims.once("bad", lambda: 1 / 0)
    assert claims.status("bad") is None and claims.once("bad", lambda: 2) == 2
    clock[0] += 101
    assert claims.status("k") is None and claims.once("k", lambda: 8) == 8


def test_upsert_task(spark, tmp_path):
    t, claims = up.store(spark, str(tmp_path / "t")), Claims(spark, str(tmp_path / "c"))
    d, c, e = rows(spark, {"a": ("h1", [("a1", None, "one")])})
    key = up.idempotency_key("t1", "space", "h1", None)
    with pytest.raises(ValueError, match="a1: tenant"):
        up.upsert_task(t, claims, key, "t2", d, c, e)
    with pytest.raises(ValueError, match="a1: vector"):
        up.upsert_task(t, claims, key, "t1", d, c, e, dimension=3)
    with pytest.raises(ValueError, match="a1: document"):
        up.upsert_task(t, claims, key, "t1", d.limit(0), c, e)
    assert t.commits() == []
    assert up.upsert_task(t, claims, key, "t1", d, c, e, dimension=2) == {"inserted": 1, "chunks": 1}
    assert up.upsert_task(t, claims, key, "t1", d, c, e) == {"chunks": 0} and len(t.commits()) == 1
    assert key != up.idempotency_key("t1", "space", "h1", "p") and up.idempotency_key("a", "bc") != up.idempotency_key("ab", "c")
