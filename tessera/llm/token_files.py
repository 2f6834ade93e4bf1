"""Token ids as binary files: one zstandard frame a document, one shared dictionary.

A container holds consecutive documents in ascending doc_id order:

    "TIDS" | version u8 | id width u8 | SHA-256 of the dictionary | documents u32
    then for each document: has_id u8 | doc_id i64 | offset of its frame u64 | tokens u32
    then the frames

Any document is read from its container with two small reads, the index row and the frame.
Executors reach the shared store through Spark only, so containers travel as the binary
column of a table in it; a container is at most `container_bytes` unless one document is more.

The text is encoded by the library word by word: nothing in the model (NFC, lower case, the
pre-token pattern, merges with word ends, special strings) reaches across a space or line
feed, so each distinct word is encoded once per worker (a bounded table).

Defined results: a null text is an empty one (the end id only); a null doc_id sorts first;
equal doc_ids are ordered by their tokens' number and bytes; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_MODEL, arrow_rows, shuffle_width, tokenizer_file, written

MAGIC, VERSION = b"TIDS", 1
#: Marks that end words; the library makes a run of them one token of its own wherever it follows a letter or digit and ends the word.
MARKS = ".,;:!?$#&%*"
#: What isn't a Latin letter (lower-cased letter by letter) or a lesser character; a closing mark between a letter or digit and a word's end.
NOT_LATIN, CLOSING = re.compile("[\u0130\u0250-\U0010ffff]"), re.compile(r"[.,;:!?](?![^ \n])(?<=[0-9a-zà-öø-ÿ].)")
#: What tells a text that has rarer marks or runs of marks, for which there is a slower pattern: one to three marks.
RARER = ("$", "#", "&", "%", "*", "!!", "??")
RUNS = re.compile(r"[M](?:(?![^ \n])(?<=L.)|[M](?:(?![^ \n])(?<=L..)|[M](?![^ \n])(?<=L...)))".replace("M", MARKS).replace("L", "[0-9a-zà-öø-ÿ]"))
HEAD, ROW = struct.Struct("<4sBB32sI"), struct.Struct("<BqQI")


def byte_level() -> dict[int, int]:
    """Byte-level BPE writes visible bytes as themselves and the others as characters from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LEVEL = byte_level()


class WordTable(dict):
    """word -> its ids as little-endian bytes; bounded by two generations."""

    def __init__(self, model: str, generation: int = 250_000, longest: int = 80):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.generation, self.longest, self.old = Tokenizer.from_file(tokenizer_file(model)), generation, longest, {}
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")  # of little-endian machines
        self.model, self.special = self.tokenizer.model, [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self[""] = b""

    def ids(self, word: str) -> bytes:
        """A word's ids; its parts are looked up where the library would split or lower it alike.

        Closing marks after what the library's normalizer leaves as a letter or digit are tokens
        of their own (after a combining mark, as of a letter that NFC takes apart, they aren't). A word of Latin letters
        (composed, and lower-cased letter by letter) is one pre-token, which goes to the
        library's merges without its normalizer. All else is encoded by the whole library.
        """
        core = word.rstrip(MARKS)
        if core and core != word and (core if core.isascii() else self.tokenizer.normalizer.normalize_str(core))[-1:].isalnum():
            return self[core] + self[word[len(core) :]]
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            low = word.lower()
            if low != word:
                return self[low]
            found = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL))]
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array(self.code, found).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.ids(word)
            if len(word) > self.longest:
                return found
        if len(self) >= self.generation:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def serialized(self, text: str | None, end_id: int) -> bytes:
        words = self.plainer(text or "").replace("\n", " ").split(" ")
        return b"".join([*map(self.__getitem__, words), end_id.to_bytes(self.width, "little")])

    def plainer(self, text: str) -> str:
        """A text of Latin letters in lower case, with closing marks as words of their own: the same ids from fewer words.

        Any other text, and one that holds a special string (or would in lower case), as it is.
        """
        if not text.isascii() and NOT_LATIN.search(text):
            return text
        low = text.lower()
        if any(s in low for s in self.special):
            return text
        return (RUNS if any(m in low for m in RARER) else CLOSING).sub(r" \g<0>", low)


@lru_cache(maxsize=4)
def word_table(model: str) -> WordTable:
    return WordTable(model)


@lru_cache(maxsize=4)
def coders(dictionary: bytes, level: int):
    import zstandard as zstd

    shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    return zstd.ZstdCompressor(level=level, dict_data=shared), zstd.ZstdDecompressor(dict_data=shared)


def train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; raw content where they are too few to train one."""
    import zstandard as zstd

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class TokenFiles:
    """Written containers and what is needed to read them."""

    containers: DataFrame  # range_id, start_in_range, n_docs, n_tokens, content
    dictionary: bytes
    width: int


def pack(docs: list[tuple], dictionary_hash: bytes, width: int) -> bytes:
    """A container of (doc_id, n_tokens, frame) rows."""
    out, at = [HEAD.pack(MAGIC, VERSION, width, dictionary_hash, len(docs))], HEAD.size + ROW.size * len(docs)
    for doc_id, n, frame in docs:
        out.append(ROW.pack(doc_id is not None, doc_id or 0, at, n))
        at += len(frame)
    return b"".join([*out, *(frame for _, _, frame in docs)])


def index(content: bytes, dictionary: bytes) -> tuple[int, list[tuple]]:
    """(id width, [(doc_id, offset, end, n_tokens)]) of a container; its dictionary is checked."""
    magic, version, width, digest, n = HEAD.unpack_from(content)
    if magic != MAGIC or version != VERSION or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a container of this dictionary")
    rows = [ROW.unpack_from(content, HEAD.size + i * ROW.size) for i in range(n)]
    ends = [r[2] for r in rows[1:]] + [len(content)]
    return width, [(doc_id if has else None, at, end, tokens) for (has, doc_id, at, tokens), end in zip(rows, ends)]


def document(content: bytes, at: int, end: int, width: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document."""
    return np.frombuffer(coders(dictionary, 3)[1].decompress(content[at:end]), f"<u{width}")


def write_tokens(docs: DataFrame, model: str = WORD_MODEL, end_id: int = 1, sample_docs: int = 1500, sample_chars: int = 16_384, dictionary_bytes: int = 65_536, level: int = 3, container_bytes: int = 4 << 20) -> TokenFiles:
    """Encode, compress and write every whole text in ascending doc_id order.

    The dictionary is trained in one task on `sample_docs` documents at most, of at most
    `sample_chars` characters, those with the least hash of id and text. Frames, not texts, are shuffled: each goes to
    its doc_id range, of which there are as many as shuffle partitions.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    ranges = shuffle_width(spark)
    places = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000) if ranges > 1 else F.lit(None)
    n, cuts = docs.agg(F.count("*"), places).first()  # reads doc_ids only
    every, cuts = max(1, n // (4 * sample_docs)), sorted(set(cuts or []))
    hashed = docs.where(F.length("text") <= sample_chars).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    sample = hashed.where(F.pmod("h", F.lit(every)) == 0).orderBy("h", "text").limit(sample_docs)  # few rows come to the sort, however many a table has

    def trained(batches: Iterator[dict]) -> Iterator[dict]:
        texts = sorted(t for b in batches for t in b["text"])
        yield {"dictionary": [train([word_table(model).serialized(t, end_id) for t in texts], dictionary_bytes)]}

    dictionary = arrow_rows(sample.select("text").repartition(1), trained, "dictionary binary").first()
    dictionary = bytes(dictionary.dictionary) if dictionary else train([], dictionary_bytes)
    width, digest = word_table(model).width, hashlib.sha256(dictionary).digest()

    def frames(batches: Iterator[dict]) -> Iterator[dict]:
        words, (compressor, _) = word_table(model), coders(dictionary, level)
        for b in batches:
            raw = [words.serialized(t, end_id) for t in b["text"]]
            yield {"range_id": [0 if d is None else bisect_right(cuts, d) for d in b["doc_id"]], "doc_id": b["doc_id"], "n_tokens": [len(r) // width for r in raw], "frame": [compressor.compress(r) for r in raw]}

    def packed(batches: Iterator[dict]) -> Iterator[dict]:
        held, size, now, start = [], 0, None, 0

        def flush() -> Iterator[dict]:
            nonlocal held, size, start
            if held:
                n = sum(r[1] for r in held)
                yield {"range_id": [now], "start_in_range": [start], "n_docs": [len(held)], "n_tokens": [n], "content": [pack(held, digest, width)]}
                held, size, start = [], 0, start + n

        for b in batches:
            for r, *row in zip(b["range_id"], b["doc_id"], b["n_tokens"], b["frame"]):
                if r != now or size + len(row[2]) > container_bytes:
                    yield from flush()
                    if r != now:
                        now, start = r, 0
                held.append(row)
                size += len(row[2])
        yield from flush()

    out = arrow_rows(docs, frames, "range_id int, doc_id long, n_tokens long, frame binary").repartition(ranges, "range_id").sortWithinPartitions("range_id", "doc_id", "n_tokens", "frame")
    out = arrow_rows(out, packed, "range_id int, start_in_range long, n_docs long, n_tokens long, content binary")
    return TokenFiles(written(out, "token-files", "none"), dictionary, width)


def read_tokens(files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or ids) of every document, from the containers.

    start: ids of all documents before it. Ranges are as many as shuffle partitions were, so
    their totals are a few numbers.
    """
    before, base = 0, {}
    for r in sorted(files.containers.groupBy("range_id").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r.range_id], before = before, before + r.n
    dictionary = files.dictionary

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for r, start, content in zip(b["range_id"], b["start_in_range"], b["content"]):
                width, found = index(content, dictionary)
                at, out = base[r] + start, {"doc_id": [], "start": [], "n_tokens": [], "ids" if with_ids else "ids_crc32": []}
                for doc_id, begin, end, n in found:
                    ids = document(content, begin, end, width, dictionary)
                    if len(ids) != n:
                        raise ValueError("a frame and its index row differ")
                    for k, v in zip(out, (doc_id, at, n, ids.tolist() if with_ids else zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[k].append(v)
                    at += n
                yield out

    return arrow_rows(files.containers.select("range_id", "start_in_range", "content"), rows, "doc_id long, start long, n_tokens long, " + ("ids array<long>" if with_ids else "ids_crc32 long"))


def token_files_digest(docs: DataFrame, model: str = WORD_MODEL) -> DataFrame:
    return read_tokens(write_tokens(docs, model))
