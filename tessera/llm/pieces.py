"""SentencePiece encoding, decoding and token counts by distinct marked words.

The BPE model marks each space with U+2581 and puts one mark before a text. No piece of the
model holds a mark after another character (`marks_lead` proves that), so no merge crosses
from a word into the marks that follow it: a text falls apart into chunks, each a run of marks
and the characters up to the next mark, and the ids of the text are the ids of its chunks,
one after another. Each distinct chunk is segmented once by the library; a text is then a
list of look-ups by position.

Tables are local to a Python worker and bounded (`generation` entries in each of two
generations); what falls out is segmented again. They grow with neither input nor cluster.

Defined results: a null text counts as an empty one and has no ids; a text of any length is
encoded whole; repeated rows give repeated results; an empty table gives no rows; columns
other than doc_id and text aren't read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import PIECE_MODEL, arrow_rows, tokenizer_file

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))


def marks_lead(sp) -> bool:
    """Whether every piece has marks at its start only, so that chunks are independent."""
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


class ChunkTable(dict):
    """chunk (without its first mark, marks as spaces) -> value(ids), each made once.

    Two generations bound it: when the young one is full it becomes the old one.
    """

    def __init__(self, model: str, value: Callable, generation: int = 250_000, longest: int = 80):
        super().__init__()
        self.sp, self.value, self.generation, self.longest, self.old = processor(model), value, generation, longest, {}
        if not marks_lead(self.sp):
            raise ValueError(f"{model} has pieces across whitespace marks")
        self.lone = [self.sp.piece_to_id(MARK)]

    def ids(self, chunk: str) -> list[int]:
        return self.sp.encode(chunk, num_threads=1) if chunk else self.lone

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.value(self.sp, self.ids(chunk))
            if len(chunk) > self.longest:
                return found
        if len(self) >= self.generation:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def of(self, text: str | None) -> list:
        """The values of a text's chunks, by position."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [self[c[1:]] for c in CHUNK.findall(" " + text)]
        return [self[c] for c in text.split(" ")]


def whole_tokens(sp) -> dict[str, int]:
    """Chunks that are proven to encode alone as one token: the library itself is asked."""
    found = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if piece.startswith(MARK) and sp.encode(chunk := piece[1:].replace(MARK, " ")) == [i]:
            found[chunk] = 1
    return found


@lru_cache(maxsize=4)
def count_tables(model: str) -> tuple[dict[str, int], ChunkTable]:
    return whole_tokens(processor(model)), ChunkTable(model, lambda sp, ids: len(ids))


def count_tokens(text: str | None, model: str = PIECE_MODEL) -> int:
    """Tokens of one text: whole-token chunks count directly, only the rest is merged."""
    whole, rest = count_tables(model)
    if not text:
        return 0
    if MARK in text:
        text = text.replace(MARK, " ")
    chunks = [c[1:] for c in CHUNK.findall(" " + text)] if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")
    merged = [c for c in chunks if c not in whole]
    return len(chunks) - len(merged) + sum([rest[c] for c in merged])


def token_counts(docs: DataFrame, model: str = PIECE_MODEL, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = [count_tokens(t, model) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "n_bytes": [len((t or "").encode()) for t in b["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=4)
def id_table(model: str) -> ChunkTable:
    """chunk -> (number of ids, ids as decimals joined by commas, decoded text)."""
    return ChunkTable(model, lambda sp, ids: (len(ids), ",".join(map(str, ids)), sp.decode(ids)))


def encode(text: str | None, model: str = PIECE_MODEL) -> list[int]:
    return [int(i) for _, ids, _ in id_table(model).of(text) for i in ids.split(",")]


def encoded(docs: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """doc_id, ids and decoded text of every whole text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        chunks = id_table(model)
        for b in batches:
            parts = [chunks.of(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "ids": [[int(i) for _, ids, _ in p for i in ids.split(",")] for p in parts], "decoded": [" ".join([d for _, _, d in p]) for p in parts]}

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """encoded() with its ids and decoded texts as digests, made where they arise.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8).
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        chunks = id_table(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in b["text"]:
                parts = chunks.of(t)
                out["n_tokens"].append(sum([n for n, _, _ in parts]))
                out["ids_sha256"].append(sha(",".join([i for _, i, _ in parts])))
                out["decoded_sha256"].append(sha(" ".join([d for _, _, d in parts])))
            yield out

    return arrow_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
