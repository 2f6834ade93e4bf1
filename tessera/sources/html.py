"""HTML pages as blocks: a distributed parser over the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that hold no content, and marks of navigation.
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "header", "footer", "aside", "nav"}
NAVIGATION = ["nav", "menu", "breadcrumb", "sidebar", "footer", "header"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "pre", "ul", "ol", "table", "figure", "figcaption", *(f"h{i}" for i in range(1, 7))}
SCHEMA = "page_id long, block int, kind string, text string, section_path array<string>"


class Reader(HTMLParser):
    """Collects (kind, text, section path) blocks in reading order."""

    def __init__(self, rows: int = 5):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.path: list[tuple[int, str]] = []
        self.skip, self.stack, self.buffer, self.kind = 0, [], [], None
        self.table: list[list[str]] | None = None
        self.rows = rows

    def boiler(self, tag: str, attrs: dict) -> bool:
        names = (attrs.get("class") or "").lower().split()
        return tag in DROPPED or attrs.get("role") in ("navigation", "banner", "contentinfo") or any(n.startswith(x) for n in names for x in NAVIGATION)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.skip:
            self.skip += tag not in VOID
            return
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            if tag == "img" and (attrs.get("alt") or attrs.get("src")):
                self.flush()
                self.add("image", attrs.get("alt") or attrs["src"])
            return
        if self.boiler(tag, attrs):
            self.flush()
            self.skip = 1
            return
        if tag == "table":
            self.flush()
            self.table = []
        elif self.table is not None:
            if tag == "tr":
                self.table.append([])
            elif tag in ("td", "th"):
                self.buffer = []
        elif tag == "li":
            self.buffer.append("\n")
        elif tag in BLOCKS:
            self.flush()
            self.kind = {"pre": "code", "ul": "list", "ol": "list", "figcaption": "paragraph", "figure": "paragraph", "p": "paragraph"}.get(tag, "heading" if tag[0] == "h" else "paragraph")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag not in VOID
            return
        if self.table is not None:
            if tag in ("td", "th"):
                (self.table or [[]])[-1:][0].append(" ".join("".join(self.buffer).split()))
                self.buffer = []
            elif tag == "table":
                rows = [r for r in self.table if any(r)]
                self.table = None
                if rows:
                    self.add("table_summary", "\n".join([f"Table rows={len(rows)} columns={max(map(len, rows))}", *("\t".join(r) for r in rows[: self.rows + 1])]))
        elif tag in BLOCKS:
            level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
            self.flush(level)

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)

    def add(self, kind: str, text: str) -> None:
        self.blocks.append((kind, text, [t for _, t in self.path][:10]))

    def flush(self, level: int = 0) -> None:
        raw, kind = "".join(self.buffer), self.kind or "other"
        text = raw.strip("\n") if kind == "code" else "\n".join(x for x in (" ".join(line.split()) for line in raw.split("\n")) if x) if kind == "list" else " ".join(raw.split())
        self.buffer, self.kind = [], None
        if not text.strip():
            return
        if level:
            while self.path and self.path[-1][0] >= level:
                self.path.pop()
            self.path.append((level, text[:128]))
        self.add(kind, text)


def blocks(html: str | None) -> list[tuple[str, str, list[str]]]:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def parse(pages: DataFrame) -> DataFrame:
    """page_id, block, kind, text, section_path of every page (page_id, html); broken markup is read as far as it goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *x) for i, h in zip(b["page_id"], b["html"]) for k, x in enumerate(blocks(h))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "kind", "text", "section_path"])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)


def language(html: Column) -> Column:
    """The html element's lang, else a language meta; null if it isn't a language tag."""
    found = F.coalesce(F.nullif(F.regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(html, '(?i)<meta[^>]*content-language"[^>]*content="([^"]*)"', 1), F.lit("")))
    return F.when(found.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), F.lower(found))


def tag_counts(html: Column, tags: list[str]) -> list[Column]:
    return [F.regexp_count(F.lower(html), F.lit(f"<{t}[ >]")).cast("int").alias(f"n_{t}") for t in tags]
