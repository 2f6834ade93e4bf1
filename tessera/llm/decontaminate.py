"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside a task. Its text is a sequence of word symbols; a
word outside every item and a pair of neighbours that no item has can't lie inside an
occurrence, so they end a run, and runs shorter than the shortest window are left out: an
exact reduction. Over the runs the shard builds a suffix array, the Burrows-Wheeler
transform, a wavelet matrix for ranks and sampled suffix positions. All windows of the items
are searched backwards at once; matched rows walk to a sampled position, which gives the
word positions; covered words merge into removal spans.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is
one window. Words: A-Z lower-cased, runs of digits, a-z and all non-ASCII characters.

Items, the stated query set, are sent out in blocks of about `block_words` words, and a
shard is searched once for each block. A null item_id is named by an empty string.

Defined results: null and empty texts have no words and no hits; null and empty items have
no windows; equal items are all named; repeated rows give repeated results; empty tables
give no rows or no hits; columns but doc_id, text, item_id aren't read (clean() keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, written

KEPT = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
SPACED = bytes(c if c in KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WORD = re.compile(rb"[^\x20]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(SPACED).split()


@dataclass
class Windows:
    """A block of items: its vocabulary, distinct windows by length, and the items of each."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # sorted codes of neighbours that items have
    shortest: int
    groups: list[tuple[np.ndarray, list[list[str]]]]  # (windows x length, their item ids)

    @staticmethod
    def of(items: list[tuple[str, str | None]], width: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        pairs: set[tuple[int, int]] = set()
        for item_id, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            pairs.update(zip(ids, ids[1:]))
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found[tuple(ids[i : i + width])].add(item_id)
        by_length = defaultdict(list)
        for w, names in found.items():
            by_length[len(w)].append((w, sorted(names)))
        base = len(vocabulary) + 1
        codes = np.unique(np.array([a * base + b for a, b in pairs], np.int64))
        return Windows(vocabulary, codes, min(by_length, default=width), [(np.array([w for w, _ in g], np.int64), [n for _, n in g]) for g in by_length.values()])


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, level by level over the symbols' bits."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, rest = [], sequence
        for level in range(bits - 1, -1, -1):
            bit = (rest >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int64)
            self.levels.append((level, ones, len(rest) - int(ones[-1])))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        begin, end = np.zeros_like(end), end
        for level, ones, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            b, e = ones[begin], ones[end]
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank before that place."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for level, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at] == 1
            symbol |= one.astype(np.int64) << level
            b, e = ones[begin], ones[at]
            begin, at = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, at - e)
        return symbol, at - begin


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: ranks of 2^k symbols give ranks of 2^(k+1)."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Over runs of symbols from 1; a separator ends each run and starts no match."""

    def __init__(self, runs: np.ndarray, run_start: np.ndarray, sigma: int, sample: int = 8):
        """runs: symbols with a 0 after each run; run_start: place of each place's run."""
        n, separators = len(runs), runs == 0
        apart = np.where(separators, np.cumsum(separators), runs + int(separators.sum()))  # each separator differs
        order = suffix_array(apart)
        self.wavelet = WaveletMatrix(runs[order - 1], max(1, int(sigma).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=sigma + 1))))
        kept = (order - run_start[order]) % sample == 0  # the start of each run is kept, so no walk leaves its run
        self.sampled, self.position = kept, np.where(kept, order, -1)

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur."""
        who, last = np.arange(len(patterns)), patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for at in range(patterns.shape[1] - 2, -1, -1):
            who, low, high = (x[low < high] for x in (who, low, high))
            symbol = patterns[who, at]
            low, high = self.first[symbol] + self.wavelet.rank(symbol, low), self.first[symbol] + self.wavelet.rank(symbol, high)
        return tuple(x[low < high] for x in (who, low, high))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            found[open_[done]] = self.position[rows[done]] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, rank = self.wavelet.access(rows)
            rows, steps = self.first[symbol] + rank, steps + 1
        return found


def occurrences(symbols: np.ndarray, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
    """(places, window, length, items of each window) in a shard's symbols; 0: no item's word."""
    base = len(windows.vocabulary) + 1
    code = symbols[:-1] * base + symbols[1:]
    at = np.searchsorted(windows.pairs, code)
    joined = np.zeros(len(symbols), bool)  # to the symbol before
    if len(windows.pairs):
        joined[1:] = (symbols[:-1] > 0) & (symbols[1:] > 0) & (windows.pairs[np.minimum(at, len(windows.pairs) - 1)] == code)
    starts = np.flatnonzero((symbols > 0) & ~joined)
    breaks = np.flatnonzero(~joined)
    ends = np.append(breaks, len(symbols))[np.searchsorted(breaks, starts, side="right")]
    long = ends - starts >= windows.shortest
    starts, lengths = starts[long], (ends - starts)[long]
    if not len(starts):
        return
    total = int((lengths + 1).sum())
    run_at = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    run_start = np.repeat(run_at, lengths + 1)
    origin = np.arange(total) - run_start + np.repeat(starts, lengths + 1)
    runs = symbols[np.minimum(origin, len(symbols) - 1)].copy()
    runs[run_at + lengths] = 0
    fm = FMIndex(runs, run_start, base - 1)
    for patterns, names in windows.groups:
        who, low, high = fm.ranges(patterns)
        n = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.empty(0, np.int64)
        yield origin[fm.locate(rows)], np.repeat(who, n), patterns.shape[1], names


def scan(texts: list[str | None], windows: list[Windows], shard_words: int) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: number of words, merged spans [first, end) of hit words, sorted item ids."""
    shard: list[list[bytes]] = []

    def flush() -> Iterator[tuple]:
        ends = np.cumsum([len(w) + 1 for w in shard])  # a gap after each document
        hit, items = np.zeros(int(ends[-1]) + 1, np.int64), [set() for _ in shard]
        for block in windows:
            get = block.vocabulary.get
            symbols = np.fromiter((s for w in shard for s in (*map(get, w, [0] * len(w)), 0)), np.int64, int(ends[-1]))
            for places, window, length, names in occurrences(symbols, block):
                np.add.at(hit, places, 1)
                np.add.at(hit, places + length, -1)
                doc = np.searchsorted(ends, places, side="right")
                for d, w in {*zip(doc.tolist(), window.tolist())}:
                    items[d].update(names[w])
        covered = np.cumsum(hit) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
        spans: list[list] = [[] for _ in shard]
        for first, end in edges.reshape(-1, 2).tolist():
            d = int(np.searchsorted(ends, first, side="right"))
            start = int(ends[d]) - len(shard[d]) - 1
            spans[d].append((first - start, end - start))
        for w, s, names in zip(shard, spans, items):
            yield len(w), s, sorted(names)

    size = 0
    for text in texts:
        shard.append(words(text))
        size += len(shard[-1])
        if size >= shard_words:
            yield from flush()
            shard, size = [], 0
    if shard:
        yield from flush()


def blocks_of(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Broadcast]:
    """Broadcasts of the items, one after another: each of about block_words words at most, counted first, and gone when the next is asked for.

    Items are dealt by a hash of id and text, so that equal or null ids don't meet in one block; an item is never split.
    """
    items, n = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), block_count(benchmark, block_words)
    for k in range(n):
        sent = benchmark.sparkSession.sparkContext.broadcast(Windows.of([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], width))
        yield sent
        if n > 1:
            sent.destroy()


def block_count(benchmark: DataFrame, block_words: int) -> int:
    return 1 + (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * block_words)


FOUND = "doc_id long, n_words long, spans array<struct<first: long, end: long>>, items array<string>"


def found_in(docs: DataFrame, sent: Broadcast, shard_words: int) -> DataFrame:
    """doc_id, n_words, spans and items of every document by the windows of one block, and whatever other columns docs have."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in more)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        windows = [sent.value]
        for b in batches:
            found = list(scan(b["text"], windows, shard_words))
            yield {"doc_id": b["doc_id"], "n_words": [n for n, _, _ in found], "spans": [[{"first": f, "end": e} for f, e in s] for _, s, _ in found], "items": [i for _, _, i in found]} | {c: b[c] for c in more}

    return arrow_rows(docs, rows, FOUND + kinds)


def merged_spans(spans: Column) -> Column:
    """Spans in order, those that touch as one."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(out) == 0, F.array(s)).when(s["first"] <= last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first: bigint, end: bigint>>"), add)


def passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 1 << 20, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, spans (first and end word of each removal span), items of every document.

    A benchmark of more than block_words words is gone through block by block: each block has a
    pass over the documents of its own, and what it finds is written before the next is sent.
    Rows of one doc_id and text are one document to it, with the same result.
    """
    docs = docs.select("doc_id", "text")
    if block_count(benchmark, block_words) == 1:
        return found_in(docs, next(blocks_of(benchmark, width, block_words)), shard_words)
    first, hits = by_blocks(docs, benchmark, width, shard_words, block_words)
    out = first.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left")
    return out.select("doc_id", "n_words", F.coalesce("s", F.array().cast("array<struct<first: bigint, end: bigint>>")).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def by_blocks(docs: DataFrame, benchmark: DataFrame, width: int, shard_words: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and n_words of every document; and of those with passages d, k (its id and key), s (spans), i (items)."""
    keyed = docs.withColumn("key", F.sha2(F.col("text"), 256))
    parts = [written(found_in(keyed, sent, shard_words), "passages") for sent in blocks_of(benchmark, width, block_words)]
    hits = reduce(DataFrame.unionAll, [p.where(F.size("spans") > 0) for p in parts]).dropDuplicates(["doc_id", "key", "spans", "items"])
    whole = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(merged_spans(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    return parts[0].select("doc_id", "key", "n_words"), whole


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(SPACED))]
    out, last = [], 0
    for first, end in spans:
        out.append(raw[last : at[first][0]])
        last = at[end - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 1 << 20, block_words: int = 2_000_000) -> DataFrame:
    """The documents with removal spans cut from their texts; all rows and columns stay, n_chars (if there) is counted anew."""
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    if block_count(benchmark, block_words) == 1:
        sent, taken = next(blocks_of(benchmark, width, block_words)), docs
    else:
        _, hits = by_blocks(docs.select("doc_id", "text"), benchmark, width, shard_words, block_words)
        own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        taken = own.join(hits, F.col("row.doc_id").eqNullSafe(F.col("d")) & F.sha2(F.col("row.text"), 256).eqNullSafe(F.col("k")), "left").select("row.*", F.col("s").alias("removal_spans"))
        sent = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if sent is not None:
                spans = [s for _, s, _ in scan(texts, [sent.value], shard_words)]
            else:
                spans = [[(x["first"], x["end"]) for x in s or []] for s in b.column(b.num_columns - 1).to_pylist()]
                b = pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1]))
            cleaned = [without(t, s) if s else t for t, s in zip(texts, spans)]
            new = b.set_column(at, b.schema.field(at), pa.array(cleaned, b.schema.field(at).type))
            if counted is not None:
                lengths = [len(c) if c is not t else n for c, t, n in zip(cleaned, texts, b.column(counted).to_pylist())]
                new = new.set_column(counted, b.schema.field(counted), pa.array(lengths, b.schema.field(counted).type))
            yield new

    return taken.mapInArrow(run, docs.schema)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, ws, least(10, len(ws)) AS l FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, l, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: array_to_string(ws[i:i + l - 1], ' '))) AS k FROM items),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, l, unnest(list_transform(range(1, len(ws) - l + 2), lambda i: {{'i': i, 'k': array_to_string(ws[i:i + l - 1], ' ')}})) AS p FROM docs, (SELECT DISTINCT l FROM items)),
hits AS (SELECT places.doc_id, places.l, places.p.i AS i, windows.item FROM places JOIN windows ON places.l = windows.l AND places.p.k = windows.k),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(named.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
