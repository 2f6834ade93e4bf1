"""Alignment of two tokenizers' tokens, by distinct segments.

Space and text are encoded by a byte-level BPE (A) and the text, before which it puts a space
itself, by a SentencePiece BPE (B). Byte offsets where tokens of both end cut the tokens into
groups; tokens whose byte ranges overlap are linked.

A text falls apart before its runs of white space. `Pair.breaks` proves from both
vocabularies which white-space characters can begin such a run: no entry has them after
another character, so that no merge crosses, and A's pre-tokens have white space at their
start only. A segment's ids are therefore the same in every text, and a text's groups and
links are those of its segments, one after another.

A task keeps a table of the distinct segments of a block, a bounded stretch of its input; each
is encoded and aligned once, and the block's documents are composed from the table by
position. A block's linked id pairs are numbered; a document carries the numbers of its pairs.
Spark adds the pairs of all blocks up, and the counts return to the blocks that have the pair,
whose documents then sum over their links. Pairs have one row a block, not one an occurrence,
and neither texts nor segments are shuffled; tables that grow with the corpus aren't sent to
any task whole. Memory holds one block.

Defined results: texts that are null or empty, or whose joined tokens aren't space and text
(those with U+2581, which B takes for a space), have no tokens: zeros and an empty string,
and no part in any count. Null and repeated doc_ids and repeated rows are documents of their
own; a text or segment of any length is aligned whole; an empty table gives no rows; columns
other than doc_id and text aren't read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import MARK, marks_lead, processor
from .shared import PIECE_MODEL, scratch, tokenizer_file, written

BYTE_MODEL = "byte_bpe_50k.json"
#: The characters that the pattern of A's pre-tokenizer takes as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable bytes stand for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligned(NamedTuple):
    """Of a list of segments: numbers of tokens and groups, the groups as text, and the links, one segment after another."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    n_links: np.ndarray
    links: np.ndarray


class Pair:
    """Both tokenizers, the bytes of their ids, and the segments at which they can't merge."""

    def __init__(self, a: str, b: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a, self.b = Tokenizer.from_file(tokenizer_file(a)), processor(b)
        self.a.encode_special_tokens = True
        with open(tokenizer_file(a)) as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{a} is no plain byte-level tokenizer")
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = entry.encode() if special.get(entry) == i else bytes(letters[c] for c in entry)
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.a_words = np.array([[f"{i}{end}" for i in range(len(self.a_bytes))] for end in (",", "|")], object)
        self.b_words = np.array([[f"{i}{end}" for i in range(len(self.b_bytes))] for end in (",", ";", "")], object)
        self.mark = self.b.piece_to_id(MARK)
        self.safe = self.breaks()
        if " " not in self.safe:
            raise ValueError("the vocabularies merge across spaces: texts have no segments")
        white, safe = re.escape(WHITE), re.escape(self.safe)
        other = "".join(c for c in WHITE if c not in self.safe)
        self.segments = re.compile(f"[{safe}][{white}]*[^{white}]*(?:[{re.escape(other)}][{white}]*[^{white}]*)*")

    def piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace(MARK, " ").encode()

    def breaks(self) -> str:
        """The ASCII white space before which neither vocabulary can merge: in no entry of A does it follow anything but
        white space; in no piece of B does the mark follow another character, or one of the others anything at all."""
        found = []
        for c in " \t\n\x0b\x0c\r":
            crossing = re.compile(f"[^{re.escape(WHITE)}]{re.escape(c)}")
            in_b = marks_lead(self.b) if c == " " else not any(c in self.b.id_to_piece(i)[1:] for i in range(self.b.get_piece_size()))
            if in_b and not any(crossing.search(x.decode(errors="replace")) for x in self.a_bytes):
                found.append(c)
        return "".join(found)

    def split(self, text: str | None) -> list[str]:
        """The segments of space and text; none if the text has no tokens."""
        return [] if not text or MARK in text else self.segments.findall(" " + text)

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """ids by A and by B. B puts a space before what it gets: it is a segment's own, or a lone mark that is dropped."""
        in_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        in_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                in_b[k] = [self.mark]
            elif s[0] != " ":
                if in_b[k][0] != self.mark:
                    raise ValueError(f"segment {s[:20]!r} merges with the mark before it")
                del in_b[k][0]
        return in_a, in_b

    def aligned(self, segments: list[str]) -> Aligned:
        """All segments at once: their tokens stand one after another, and both sides end together at each segment's end."""
        in_a, in_b = self.encoded(segments)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (in_a, in_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (in_a, in_b))
        raw = "".join(segments).encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            raise ValueError("joined tokens aren't the segments' bytes")
        end_a, end_b = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        ends = end_a[n_a.cumsum() - 1]
        cuts = np.union1d(end_a, end_b)  # between two cuts there is one link
        links = a[np.searchsorted(end_a, cuts)] << 32 | b[np.searchsorted(end_b, cuts)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.a_words[last_a.astype(int), a]
        words[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.b_words[last_b.astype(int) + np.isin(end_b, ends), b]
        to, parts = (n_a + n_b).cumsum().tolist(), words.tolist()
        texts = ["".join(parts[lo:hi]) for lo, hi in zip([0, *to], to, strict=False)]
        per = lambda at: np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        return Aligned(n_a, n_b, per(both), texts, per(cuts), links)


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


class Block:
    """The distinct segments of a stretch of texts, aligned once each, and the numbers of their pairs."""

    def __init__(self, both: Pair):
        self.both, self.new = both, []
        self.places = Places(self.new)
        self.groups: list[str] = []
        self.numbers: dict[int, int] = {}
        self.shape, self.first, self.links = array("q"), array("q", [0]), array("I")  # shape: n_a, n_b, n_groups of each segment
        self.n = array("q")
        self.chars = 0

    def located(self, text: str | None) -> np.ndarray:
        """Positions of a text's segments in the table."""
        self.chars += len(text or "")
        return np.fromiter(map(self.places.__getitem__, self.both.split(text)), np.int64)

    def align(self, at_once: int = 4096) -> None:
        """Encode and align the segments that are new since the last call."""
        for lo in range(0, len(self.new), at_once):
            got = self.both.aligned(self.new[lo : lo + at_once])
            self.groups += got.groups
            self.shape.frombytes(np.stack([got.n_a, got.n_b, got.n_groups], 1).astype(np.int64).tobytes())
            self.first.frombytes((self.first[-1] + got.n_links.cumsum()).astype(np.int64).tobytes())
            known, at = np.unique(got.links, return_inverse=True)
            numbers = np.array([self.numbers.setdefault(p, len(self.numbers)) for p in known.tolist()], np.uint32)
            self.links.frombytes(numbers[at].tobytes())
        self.new.clear()
        self.n.extend([0] * (len(self.numbers) - len(self.n)))

    def document(self, at: np.ndarray) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the packed pairs of the text at these positions."""
        if not len(at):
            return 0, 0, 0, 0, "", None
        a, b, groups = np.frombuffer(self.shape, np.int64).reshape(-1, 3)[at].sum(0).tolist()
        first = np.frombuffer(self.first, np.int64)
        lo, size = first[at], first[at + 1] - first[at]
        where = np.arange(size.sum()) + np.repeat(lo - (size.cumsum() - size), size)
        pairs, k = np.unique(np.frombuffer(self.links, np.uint32)[where], return_counts=True)
        np.frombuffer(self.n, np.int64)[pairs] += k
        text = ";".join([self.groups[i] for i in at.tolist()])
        return a, b, groups, len(where), hashlib.sha256(text.encode()).hexdigest(), packed(pairs, k)


class Places(dict):
    """segment -> position; what is missing is added and noted."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new = new

    def __missing__(self, segment: str) -> int:
        self.new.append(segment)
        self[segment] = at = len(self)
        return at


def packed(numbers: np.ndarray, k: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs, compressed byte by byte of their steps."""
    planes = np.stack([np.diff(numbers.astype(np.int64), prepend=0), k]).astype("<u4").view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    steps, k = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
    return steps.cumsum(), k


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def blocks(docs: DataFrame, a: str, b: str, block_chars: int, texts_at_once: int = 64) -> DataFrame:
    """Rows of two kinds: a block's pairs (block, no, pair, n) and its documents (block, doc_id, their figures, packed pairs).

    A pair is a << 32 | b. A block ends with the text that reaches block_chars.
    """
    kinds = {"block": "long", "no": "int", "pair": "long", "n": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "binary"}
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, types[t]) for c, t in kinds.items()])

    def ends(number: int, block: Block) -> Iterator[tuple]:
        for (p, no), n in zip(block.numbers.items(), block.n, strict=True):
            if n:
                yield number, no, p, n, *[None] * 7

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        both, number = pair(a, b), TaskContext.get().partitionId() << 32
        block = Block(both)
        for batch in batches:
            for lo in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(lo, texts_at_once)
                texts = part.column("text")
                located = [block.located(texts[i].as_py()) for i in range(part.num_rows)]
                block.align()
                for doc_id, at in zip(part.column("doc_id").to_pylist(), located, strict=True):
                    yield number, None, None, None, doc_id, *block.document(at)
                if block.chars >= block_chars:
                    yield from ends(number, block)
                    number, block = number + 1, Block(both)
        yield from ends(number, block)

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return taken.mapInArrow(lambda batches: batches_of(rows(batches), schema), ", ".join(f"{c} {t}" for c, t in kinds.items()))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (links in the whole corpus), best (whether no pair of its B id has more)."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # at most as many rows as A has ids
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def summed(rows: DataFrame) -> DataFrame:
    """Documents with the sums over their links; the counts of a block's pairs come before its documents."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*FIGURES, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, table, known = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "no", "count", "best", "doc_id", *FIGURES, "groups_sha256", "pairs")), strict=True):
                block, no, count, best, doc_id, *figures, sha, raw = row
                if block != of:
                    of, table, known = block, None, []
                if no is not None:
                    known.append((no, count, best))
                    continue
                if table is None:
                    table = np.zeros((2, 1 + max((x for x, _, _ in known), default=0)), np.int64)
                    for no, count, best in known:
                        table[:, no] = count, best
                n_best = count_sum = 0
                if raw is not None:
                    numbers, k = unpacked(raw)
                    count_sum, n_best = (table[:, numbers] @ k).tolist()
                yield doc_id, *figures, n_best, count_sum, sha

    return rows.mapInArrow(lambda batches: batches_of(documents(batches), schema), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def cross_alignment(docs: DataFrame, a: str = BYTE_MODEL, b: str = PIECE_MODEL, block_chars: int = 1 << 25) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    n_best: links whose pair no other pair of its B id exceeds in the corpus; count_sum: the
    corpus counts of the pairs, over the links.
    """
    spark = docs.sparkSession
    with scratch(spark, "alignment") as place:
        blocks(docs, a, b, block_chars).write.option("compression", "zstd").parquet(place)
        parts = spark.read.parquet(place)
        pairs = parts.where("no is not null").select("block", "no", "pair", "n")
        texts = parts.where("no is null").select("block", "doc_id", *FIGURES, "groups_sha256", "pairs")
        counted = pairs.select("block", "no", "pair").join(pair_counts(pairs), "pair").select("block", "no", "count", "best")
        ordered = counted.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("no"))
        return written(summed(ordered), "aligned-documents")
