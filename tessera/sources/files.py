"""Files and payloads: Markdown, plain text, office documents, JSON lines and encoded bytes.

Each reader takes (id, content) rows, such as Spark's binaryFile source gives, and returns
blocks (id, block, kind, text). Office files are zip archives of XML, read with the standard library.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .commits import Change, Tables

SCHEMA = "id long, block int, kind string, text string"


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e) == "t")


def text_blocks(raw: bytes) -> list[tuple[str, str]]:
    """Paragraphs of a text in UTF-8 or else Latin-1."""
    return [("paragraph", " ".join(p.split())) for p in re.split(r"\n\s*\n", decode_text(raw)) if p.strip()]


def markdown_blocks(raw: bytes) -> list[tuple[str, str]]:
    """Fences, headings, tables, lists and paragraphs; front matter and footnotes are notes."""
    text, out = decode_text(raw).replace("\r\n", "\n"), []
    if m := re.match(r"---\n(.*?)\n---\n", text, re.S):
        out.append(("note", m[1]))
        text = text[m.end() :]
    held: list[str] = []
    kind = None

    def flush():
        nonlocal held, kind
        if held:
            body = "\n".join(held).strip("\n")
            if kind == "table_summary":
                rows = [r for r in held if not re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", r)]
                body = f"Table rows={len(rows)}\n" + "\n".join("\t".join(c.strip() for c in r.strip().strip("|").split("|")) for r in rows[:6])
            out.append((kind, body))
        held, kind = [], None

    fence = None
    for line in text.split("\n"):
        if fence:
            if line.strip().startswith(fence):
                flush()
                fence = None
            else:
                held.append(line)
            continue
        if m := re.match(r"\s*(```|~~~)", line):
            flush()
            fence, kind = m[1], "code"
            continue
        now = "heading" if re.match(r"#{1,6}\s", line) else "note" if re.match(r"\[\^[^\]]+\]:", line) else "table_summary" if line.strip().startswith("|") else "list" if re.match(r"\s*([-*+]|\d+[.)])\s", line) else "paragraph"
        if not line.strip():
            flush()
            continue
        if now == "heading":
            flush()
            out.append(("heading", line.lstrip("#").strip()))
            continue
        if now != kind and not (kind == "list" and now == "paragraph"):
            flush()
            kind = now
        held.append(line.strip() if now != "list" else line)
    flush()
    return [(k, t) for k, t in out if t.strip()]


def docx_blocks(raw: bytes) -> list[tuple[str, str]]:
    body, out = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")), []
    for e in next(x for x in body if _local(x) == "body"):
        if _local(e) == "p" and _texts(e).strip():
            style = next((v for x in e.iter() if _local(x) == "pStyle" for v in x.attrib.values()), "")
            out.append(("heading" if style.lower().startswith(("heading", "title")) else "list" if "list" in style.lower() else "paragraph", _texts(e).strip()))
        elif _local(e) == "tbl":
            rows = [[_texts(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            out.append(("table_summary", "\n".join([f"Table rows={len(rows)} columns={max(map(len, rows), default=0)}", *("\t".join(r) for r in rows[:6])])))
    return out


def pptx_blocks(raw: bytes) -> list[tuple[str, str]]:
    z, out = zipfile.ZipFile(io.BytesIO(raw)), []
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    for part, kind in (("ppt/slides/slide", "slide"), ("ppt/notesSlides/notesSlide", "note")):
        for name in sorted((n for n in z.namelist() if re.fullmatch(part + r"\d+\.xml", n)), key=number):
            lines = [_texts(p).strip() for p in ElementTree.fromstring(z.read(name)).iter() if _local(p) == "p"]
            if any(lines):
                out.append((kind, "\n".join(x for x in lines if x)))
    return out


def xlsx_blocks(raw: bytes) -> list[tuple[str, str]]:
    """Non-empty cells of each sheet, tab-joined by rows."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter():
            if _local(r) == "row":
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c if _local(x) == "v"), _texts(c))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    rows.append("\t".join(x for x in cells if x))
        if rows:
            out.append(("table_summary", "\n".join(rows)))
    return out


def image_blocks(raw: bytes) -> list[tuple[str, str]]:
    kind = next((n for m, n in ((b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"GIF8", "gif"), (b"RIFF", "webp")) if raw.startswith(m)), "unknown")
    return [("other", f"image/{kind}")]


#: Readers by media type, in the order in which they are asked.
READERS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {
    "text/markdown": markdown_blocks,
    "text/html": lambda raw: [(k, t) for k, t, _ in __import__("tessera.sources.html", fromlist=["blocks"]).blocks(decode_text(raw))],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx_blocks,
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": pptx_blocks,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx_blocks,
    "text/plain": text_blocks,
    "image/*": image_blocks,
}


def reader_name(media_type: Column, path: Column) -> Column:
    """The first reader that takes a file, by media type, else by suffix."""
    t, p = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    ends = {"text/markdown": [".md", ".markdown"], "text/html": [".html", ".htm"], "text/plain": [".txt"]}
    office = {"wordprocessingml": ".docx", "presentationml": ".pptx", "spreadsheetml": ".xlsx"}
    out = F.lit(None).cast("string")
    for name in reversed(list(READERS)):
        hit = t.startswith("image/") if name == "image/*" else t == name
        for e in ends.get(name, []) + [e for k, e in office.items() if k in name]:
            hit = hit | p.endswith(e)
        out = F.when(hit, name).otherwise(out)
    return out


def parse(files: DataFrame) -> DataFrame:
    """id, block, kind, text of files (id, media_type, content); a file that can't be read gives one block of kind error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, m, raw in zip(b["id"], b["media_type"], b["content"]):
                read = READERS.get(m) or (image_blocks if (m or "").startswith("image/") else None)
                try:
                    got = read(bytes(raw)) if read and raw is not None else []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError) as e:
                    got = [("error", type(e).__name__)]
                rows += [(i, k, *x) for k, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=["id", "block", "kind", "text"])

    return files.select("id", "media_type", "content").mapInPandas(run, SCHEMA)


def decode_text(raw: bytes) -> str:
    for charset in ("utf-8-sig", "latin-1"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return ""


@F.pandas_udf(StringType())
def decode_payload(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text of base64, gzip or deflate payloads; null if they can't be decoded."""

    def one(raw, how):
        try:
            raw = bytes(raw)
            for step in (how or "").split("+"):
                raw = base64.b64decode(raw) if step == "base64" else gzip.decompress(raw) if step == "gzip" else zlib.decompress(raw) if step == "deflate" else raw
            return decode_text(raw)
        except (ValueError, OSError, zlib.error, TypeError):
            return None

    return pd.Series([one(r, h) for r, h in zip(content, encoding)], dtype=object)


def store_objects(rows: DataFrame, path: str, by: str) -> None:
    """Rows as JSON objects under a folder for each value of a column, in whatever store the path names; bytes become base64. Folders that get no rows stay as they are."""
    texts = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in rows.dtypes]
    rows.select(*texts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).option("compression", "gzip").json(path)


def stored_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of store_objects(): schema names their columns and kinds, bytes among them."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    text = ", ".join(f"{f.name} {'string' if f.dataType.simpleString() == 'binary' else f.dataType.simpleString()}" for f in kinds)
    rows = spark.read.schema(text).json(path)
    return rows.select(*[F.unbase64(f.name).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in kinds])


#: Names of charsets that a payload may declare, as Spark calls them.
CHARSETS = {"utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-16": "UTF-16", "utf-32": "UTF-32", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "us-ascii": "US-ASCII"}


def declared_charset(content_type: Column) -> Column:
    """The charset parameter of a content type in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i);\s*charset\s*=\s*[\"']?([^\"';\s]+)", 1))


def declared_text(content: Column, content_type: Column) -> Column:
    """Text of bytes by the charset that their content type declares; else UTF-8 where they are valid, without its mark, else Latin-1."""
    named, raw = declared_charset(content_type), content.cast("string")
    out = F.when(content.isNull(), None)
    for name, charset in CHARSETS.items():
        out = out.when(named == name, F.decode(content, charset))
    return out.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON-lines file; rows that don't parse are dropped."""
    schema = "query_id string, question string, expected_ids array<string>, top_k int, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND question IS NOT NULL").drop("_bad")


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Write rows over those of the same key: one commit of a table of its own, whole or not at all; of rows of one key any counts."""
    rows = rows.dropDuplicates([key])
    Tables(spark, path, {"rows": key}).transact(lambda seen: ({"rows": Change(rows, rows.select(key))}, {}))


def current(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    return Tables(spark, path, {"rows": key}).table("rows")
