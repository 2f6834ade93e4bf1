"""Fill-in-the-middle examples, cut through a sparse index of checkpoints.

While the units of a text are counted, every `every` units the byte offset and the code-point
offset are recorded. A cut at a unit is found by binary search of the checkpoint before it and
a short rescan from there, so that a text is read once and no table of all offsets is made.
Counting goes block by block over the UTF-8 bytes as they lie in the Arrow buffer: memory
holds a block and the checkpoints, whatever the length of the text. Units are code points, or
words where that is asked for.

An example is the text itself (plain), `<P>`prefix`<S>`suffix`<M>`middle (psm) or
`<S>`suffix`<P>`prefix`<M>`middle (spm). A text that is empty or holds a mark stays plain, so
the text can always be rebuilt. All choices come from a hash of the seed and doc_id alone.

Defined results: a null text counts as an empty one; a null doc_id counts as an empty string
in the hash; repeated rows give repeated results; an empty table gives no rows; columns other
than doc_id and text aren't read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def code_points(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Offsets in data[lo:hi], from lo, at which a code point starts."""
    return np.flatnonzero((data[lo:hi] & 0xC0) != 0x80)


def words(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Offsets at which a word starts: a byte that isn't white space after one that is; the first unit starts at 0."""
    white = WHITE[data[lo:hi]]
    before = np.concatenate(([lo > 0 and bool(WHITE[data[lo - 1]])], white[:-1]))
    starts = before & ~white
    if lo == 0 and hi > 0:
        starts[0] = True
    return np.flatnonzero(starts)


class Index(NamedTuple):
    """Checkpoints of one text: number of the unit, its byte and its code-point offset; and the totals."""

    unit: np.ndarray
    byte: np.ndarray
    char: np.ndarray
    n_units: int
    n_chars: int


def index(data: np.ndarray, every: int = 1024, units: Callable = code_points, block: int = BLOCK) -> Index:
    """One pass over the bytes that counts units and code points and records each `every`-th unit."""
    found: list[tuple] = []
    n_units = n_chars = 0
    for lo in range(0, len(data), block):
        hi = min(len(data), lo + block)
        chars = code_points(data, lo, hi)
        starts = chars if units is code_points else units(data, lo, hi)
        at = starts[-n_units % every :: every]
        found.append((np.arange(len(at)) * every + n_units + (-n_units % every), lo + at, n_chars + np.searchsorted(chars, at)))
        n_units, n_chars = n_units + len(starts), n_chars + len(chars)
    unit, byte, char = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or [(), (), ()]))
    return Index(unit, byte, char, n_units, n_chars)


def offset(data: np.ndarray, ix: Index, unit: int, units: Callable = code_points) -> tuple[int, int]:
    """(byte, code point) at which a unit starts; the ends of the text for n_units."""
    if unit >= ix.n_units:
        return len(data), ix.n_chars
    k = int(np.searchsorted(ix.unit, unit, "right")) - 1
    lo, hi = int(ix.byte[k]), int(ix.byte[k + 1]) if k + 1 < len(ix.byte) else len(data)
    at = int(units(data, lo, hi)[unit - int(ix.unit[k])])
    return lo + at, int(ix.char[k]) + len(code_points(data, lo, lo + at))


def drawn(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of sha256 of `seed:doc_id`."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def examples(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, every: int = 1024, units: Callable = code_points, batch_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain), output.

    plain: per cent of texts left as they are; spm: per cent of the others in the order
    suffix, prefix, middle; batch_bytes: an output batch ends with the text that reaches it.
    """
    h1, h2, h3, h4 = drawn(seed, F.col("doc_id"))
    form = F.when(h3 % 100 >= 100 - plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    p, s, m = marks = [x.encode() for x in MARKS]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def one(raw: bytes, h1: int, h2: int, form: str) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        ix = index(data, every, units)
        if form == "plain" or not raw or any(x in raw for x in marks):
            return ix.n_units, "plain", None, None, raw
        first, last = sorted((h1 % (ix.n_units + 1), h2 % (ix.n_units + 1)))
        (b1, c1), (b2, c2) = offset(data, ix, first, units), offset(data, ix, last, units)
        parts = [p, raw[:b1], s, raw[b2:], m, raw[b1:b2]] if form == "psm" else [s, raw[b2:], p, raw[:b1], m, raw[b1:b2]]
        return ix.n_units, form, c1, c2 - c1, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for i, (doc_id, *h) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "form")), strict=True)):
                made.append((doc_id, *one(texts[i].as_py() or b"", *h)))
                held += len(made[-1][-1])
                if held >= batch_bytes:
                    yield pack()
                    made, held = [], 0
            if made:
                yield pack()
                made, held = [], 0

    return taken.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def rebuilt(output: Column, form: Column) -> Column:
    """The text of an example. The marks found first are the example's own, for the text has none."""
    after = lambda c, k: F.substring(c, F.length(k) + 4, F.length(c))  # noqa: E731  what follows k and a mark
    upto = lambda c, mark: F.substring_index(c, mark, 1)
    body = F.substring(output, F.lit(4), F.length(output))
    first = F.when(form == "psm", upto(body, "<S>")).otherwise(upto(body, "<P>"))
    rest = after(body, first)
    middle_part = upto(rest, "<M>")
    middle = after(rest, middle_part)
    whole = F.when(form == "psm", F.concat(first, middle, middle_part)).otherwise(F.concat(middle_part, middle, first))
    return F.when(form == "plain", output).otherwise(whole)


def digests(examples_: DataFrame) -> DataFrame:
    """examples() with its outputs, and the texts rebuilt from them, as SHA-256."""
    return examples_.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT *, ('0x' || h[1:8])::bigint % (n + 1) AS a, ('0x' || h[9:16])::bigint % (n + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::bigint % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::bigint % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
