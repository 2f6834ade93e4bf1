"""SimHash near-duplicates: candidates by Golay-code fuzzy hashing.

Fingerprints are 64 bits: A-Z lower-cased, words, word shingles (repeats count), XXH64 of
each, and per bit the majority over the shingles. Two link if at most 3 bits differ.

A fingerprint has three segments of 22, 21 and 21 bits, each read as a word of the perfect
binary Golay code (23 bits, 12 of them data, any word within 3 bits of one codeword). If two
segments differ in at most one bit, the codeword nearest to the one lies within 4 bits of
the other; there are 1 or 6 such codewords. So the nearest codeword is the *probe* key
of a segment and the 1 or 6 near ones are its *index* keys. With errors e0 + e1 + e2 <= 3:

    e0, e1 <= 1                       Golay keys of segments 0 and 1
    e0 >= 2, so e1 + e2 <= 1          segment 1 exact, Golay 2; or Golay 1, segment 2 exact
    e1 >= 2, so e0 + e2 <= 1          segment 0 exact, Golay 2; or Golay 0, segment 2 exact

All links are found: 5 probe keys and 36 + 4 * 6 index keys at most for each *distinct*
fingerprint. Buckets of equal keys are streamed in key order; a bucket of up to `dense`
members is verified by blocks of XOR and bit counts and leaves links to its local minima, at
most one for each member, never all pairs. Members of larger buckets go through an exact way
that is linear in them: each fingerprint within 1 bit of some value x and each within 2 bits
of x are within 3 bits of each other, and any two within 3 bits share such an x.

Defined results: null and empty texts have fingerprint zero and link like any other; a text
of fewer words than a shingle is one shingle; component_id is the smallest doc_id reachable
(null only if all of them are); empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, shuffle_width

#: Segments as (shift, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def fingerprint(text: str | None, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    joined, ends = b" ".join(words), list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    hashes = np.array([h(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprinted(batches: Iterator[pa.RecordBatch], shingle: int = 3) -> Iterator[pa.RecordBatch]:
    """Batches with fp for text. One text is a Python string at a time; the other columns stay as they are."""
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; if `keyed`, text_key too, a hash of the text."""

    key = [F.md5("text").alias("text_key")] if keyed else []
    return docs.select(F.col("doc_id").cast("long"), "text", *key).mapInArrow(lambda batches: fingerprinted(batches, shingle), "doc_id long, text_key string, fp long" if keyed else "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the 23-bit words' single bits folded into two tables, errors of weight <= 4 by syndrome)."""
    single = []
    for i in range(23):
        r = 1 << i
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        single.append(r)
    fold = np.zeros((2, 1 << 12), np.int64)
    for half in (0, 1):
        for i in range(12 - half):
            fold[half] ^= np.where(np.arange(1 << 12) >> i & 1, single[12 * half + i], 0)
    errors = np.full((1 << 11, 6), -1, np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= single[i]
            if weight < 4 or used[s] and errors[s, 0].bit_count() == 3:
                errors[s, used[s]] = sum(1 << i for i in bits)
                used[s] += 1
    return fold, errors


def near_codewords(segment: np.ndarray) -> np.ndarray:
    """Data bits of the codewords within 4 bits, nearest first; -1 where there are fewer than 6."""
    fold, errors = golay()
    e = errors[fold[0][segment & 0xFFF] ^ fold[1][segment >> 12]]
    return np.where(e >= 0, (segment[:, None] ^ e) >> 11, -1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which fingerprint, key, whether a probe) for signed fingerprints. A probe key is an index key too."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    near = [near_codewords(s) for s in seg]
    who, key, probe = [], [], []
    row = np.repeat(np.arange(len(fps)), 36)
    a, b = np.repeat(near[0], 6, axis=1).ravel(), np.tile(near[1], 6).ravel()
    kept = (a >= 0) & (b >= 0)
    who.append(row[kept]), key.append((a << 12 | b)[kept]), probe.append((np.arange(len(row)) % 36 == 0)[kept])
    row = np.repeat(np.arange(len(fps)), 6)
    for kind, (exact, fuzzy) in enumerate(((1, 2), (2, 1), (0, 2), (2, 0)), 1):
        g = near[fuzzy].ravel()
        kept = g >= 0
        who.append(row[kept]), key.append((kind << 40 | seg[exact][row] << 12 | g)[kept]), probe.append((np.arange(len(row)) % 6 == 0)[kept])
    return np.concatenate(who), np.concatenate(key), np.concatenate(probe)


def bucket_links(fps: np.ndarray, errors: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is connected inside a bucket: each fingerprint to its least neighbour.

    A second round ties the least neighbours that share a component, so that the bucket's
    links have the same components as all of its pairs.
    """
    fps = np.sort(fps)
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for at in range(0, len(fps), block):
            near = np.bitwise_count(fps[at : at + block, None].view(np.uint64) ^ fps[None].view(np.uint64)) <= errors
            label[at : at + block] = np.where(near, label[None], len(fps)).min(axis=1)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(fps))
    yield fps[other], fps[label[other]]


def links(distinct: DataFrame, errors: int = 3, dense: int = 4096) -> DataFrame:
    """(u, v) of distinct fingerprints (fp): the same components as all pairs within `errors` (3 at most) bits."""
    width = shuffle_width(distinct.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 512):
                part = fps[at : at + 512]
                who, key, _ = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who])], names=["key", "fp"])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty(0, np.int64), np.empty(0, np.int64)
        dense_key = None

        def made(u: list, v: list) -> Iterator[pa.RecordBatch]:
            if u and sum(map(len, u)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        def runs(key: np.ndarray, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Whole buckets; what may go on in the next batch is held."""
            nonlocal held_key, held, dense_key
            if not len(key):
                return
            u, v = [], []
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            first, size = edge[:-1], np.diff(edge)
            keep = 0 if last or not len(first) else size[-1]
            if keep:
                first, size = first[:-1], size[:-1]
            pair = first[size == 2]
            near = np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= errors
            u.append(fp[pair][near]), v.append(fp[pair + 1][near])
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                if n > dense or key[s] == dense_key:
                    u.append(fp[s : s + n]), v.append(fp[s : s + n])  # u = v: for the other way
                else:
                    for x, y in bucket_links(fp[s : s + n], errors):
                        u.append(x), v.append(y)
            for s in first[(size <= 2) & (key[first] == dense_key)].tolist() if dense_key is not None else ():
                u.append(fp[s : s + 2][key[s : s + 2] == dense_key]), v.append(u[-1])
            held_key, held = key[len(key) - keep :], fp[len(fp) - keep :]
            if keep > dense or keep and held_key[0] == dense_key:
                dense_key = held_key[0]
                u.append(held), v.append(held)
                held_key, held = held_key[:0], held[:0]
            yield from made(u, v)

        for b in batches:
            yield from runs(np.concatenate((held_key, b.column(0).to_numpy())), np.concatenate((held, b.column(1).to_numpy())), False)
        yield from runs(held_key, held, True)

    buckets = distinct.select("fp").mapInArrow(keyed, "key long, fp long").repartition(width, "key").sortWithinPartitions("key")
    found = cut(buckets.mapInArrow(bucketed, "u long, v long"))
    return found.where("u != v").unionAll(_ball_links(found.where("u = v").select(F.col("u").alias("fp")).distinct(), errors))


def _ball_links(members: DataFrame, errors: int) -> DataFrame:
    """Links of the members of dense buckets: through values 1 bit from one and 2 bits from the other."""
    inner = (errors - 1) // 2
    near = [0] + [1 << i for i in range(64) if inner]
    masks = {0: np.array(near, np.uint64), 1: np.array([0, *(1 << i for i in range(64)), *((1 << i | 1 << j) for i, j in combinations(range(64), 2) if errors >= 2)], np.uint64)}

    def spread(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(fps), 512):
                    part = fps[at : at + 512]
                    x = (part.view(np.uint64)[:, None] ^ masks[kind][None]).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.repeat(part, len(masks[kind])))], names=["x", "fp"])

        return members.mapInArrow(run, "x long, fp long")

    hubs = spread(0).groupBy("x").agg(F.min("fp").alias("v"))
    close = spread(0).join(hubs, "x").unionByName(spread(1).join(hubs, "x"))
    return close.where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def rooted(fps: DataFrame, errors: int, dense: int) -> DataFrame:
    """fp, root (of its component) and least doc_id of each distinct fingerprint."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct, errors, dense)).withColumnsRenamed({"node": "fp", "component": "root"})
    return cut(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, shingle: int = 3, errors: int = 3, dense: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every document."""
    fps = cut(fingerprints(docs, shingle))
    roots = rooted(fps, errors, dense)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = roots.join(least, "root").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, errors: int = 3, dense: int = 4096) -> DataFrame:
    """The documents, one of each component: that of the smallest doc_id, nulls last, and the least hash of the text. Columns stay."""
    fps = cut(fingerprints(docs, shingle, keyed=True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    by_fp = fps.groupBy("fp").agg(first.alias("first"))  # so that a fingerprint that many share is one row of the join
    kept = by_fp.join(rooted(fps, errors, dense), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")).distinct()
    keyed = docs.withColumn("_text_key", F.md5("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & keyed["_text_key"].eqNullSafe(kept["kept_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
