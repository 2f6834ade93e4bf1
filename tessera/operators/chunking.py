"""Chunkers: sequential packing of sentences, per document, and checks of their output."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+|\Z)")
HEADING = re.compile(r"(#{1,6})\s+(.*)")
ITEM = re.compile(r"\s*(\d{1,9})[.)]\s+")
# Openings that refer to something before them.
DANGLING = ["dieser ", "diese ", "dieses ", "das oben", "wie erwähnt", "this ", "these ", "the above", "as mentioned"]


def split_sentences(text: str | None) -> list[str]:
    found = [s.strip() for s in SENTENCE.findall(text or "") if s.strip()]
    return found or [x.strip() for x in (text or "").split("\n") if x.strip()]


def tokens(text: str) -> int:
    words = text.split()
    return len(text) if len(words) == 1 else len(words)


def by_limit(sentence: str, limit: int) -> list[str]:
    """Pieces of at most `limit` words."""
    words = sentence.split()
    return [sentence] if len(words) <= limit else [" ".join(words[i : i + limit]) for i in range(0, len(words), limit)]


def pack(sentences: list[str], target: int, overlap: int, limit: int) -> list[list[int]]:
    """Greedy chunks of sentence numbers: up to target tokens, starting with the last one's tail of up to overlap tokens."""
    sizes, chunks, now, n = [len(s.split()) for s in sentences], [], [], 0
    for i, size in enumerate(sizes):
        if now and (n + size > target or n + size > limit):
            chunks.append(now)
            tail, m = [], 0
            for j in reversed(now):
                if m + sizes[j] > overlap or m + sizes[j] + size > limit:
                    break
                tail.insert(0, j)
                m += sizes[j]
            now, n = tail, m
        now = [*now, i]
        n += size
    return [*chunks, now] if now else chunks


def late_boundaries(sentences: list[str], most: int = 450, least: float = 0.7, overlap: int = 80) -> list[list[int]]:
    """Chunks cut once `most` tokens are reached: where the next sentence has less than `least` of its words
    in common with the one before, with an overlap; else without one. Numbered lists stay whole."""
    words = [{*re.findall(r"\w+", s.lower())} for s in sentences]
    index = [int(m[1]) if (m := ITEM.match(s)) else None for s in sentences]
    chunks, now, n = [], [], 0
    for i, s in enumerate(sentences):
        runs_on = i > 0 and index[i] is not None and index[i - 1] is not None and index[i] == index[i - 1] + 1
        if now and n >= most and not runs_on:
            a, b = words[i - 1], words[i]
            near = len(a & b) / len(a | b) if a | b else 1.0
            tail, m = [], 0
            if near < least:
                for j in reversed(now):
                    if m + len(sentences[j]) // 4 > overlap:
                        break
                    tail.insert(0, j)
                    m += len(sentences[j]) // 4
            chunks.append(now)
            now, n = tail, m
        now = [*now, i]
        n += len(s) // 4
    return [*chunks, now] if now else chunks


def list_runs(sentences: list[str]) -> dict[int, tuple[int, int]]:
    """Sentence number -> (first, end) of the numbered list it is in, of two items or more."""
    index = [int(m[1]) if (m := ITEM.match(s)) else None for s in sentences]
    out, i = {}, 0
    while i < len(index):
        j = i + 1
        while j < len(index) and index[i] is not None and index[j] == index[j - 1] + 1:
            j += 1
        if j - i > 1:
            out |= {k: (i, j) for k in range(i, j)}
        i = j
    return out


def hashed_words(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """A vector a text: counts of its words by hash; stands in where no embedding model is given."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts):
        for w in re.findall(r"\w+", text.lower()):
            row[zlib.crc32(w.encode()) % dimensions] += 1
    return out


def window_boundaries(sentences: list[str], embed=hashed_words, target: int = 450, least: float = 0.7, overlap: int = 80, window: int = 3) -> list[list[int]]:
    """Chunks cut once `target` tokens are reached, never inside a numbered list of up to `target` tokens: with an
    overlap where the windows of `window` sentences from the last and from the next sentence are less than `least`
    alike (cosine of their vectors), and after an item of a longer list; else without one. Tokens are a quarter of the characters."""
    if not sentences:
        return []
    sizes, runs = [len(s) // 4 for s in sentences], list_runs(sentences)
    v = embed([" ".join(sentences[i : i + window]) for i in range(len(sentences))])
    norms = np.linalg.norm(v, axis=1)
    bottoms = norms[:-1] * norms[1:]
    cosines = np.divide((v[:-1] * v[1:]).sum(axis=1), bottoms, out=np.zeros(len(bottoms)), where=bottoms > 0)
    chunks, start, n = [], 0, 0
    for i, size in enumerate(sizes):
        n += size
        if n < target:
            continue
        a, b = runs.get(i, (i, i + 1))
        long_list = sum(sizes[a:b]) > target
        if i + 1 < b and not long_list:
            continue
        chunks.append([*range(start, i + 1)])
        new, n = i + 1, 0
        if i + 1 < len(sizes) and cosines[i] < least or i + 1 < b and long_list:
            while new > start and n + sizes[new - 1] <= overlap:
                new -= 1
                n += sizes[new]
        start = new
    return [*chunks, [*range(start, len(sizes))]] if start < len(sizes) else chunks


def given_boundaries(ends, n: int) -> list[list[int]] | None:
    """Chunks of n sentences by the ends that a model gave (ascending, the last one n); None if they aren't that."""
    ends = [int(e) for e in ends] if ends is not None else []
    if not ends or ends[-1] != n or any(b <= a for a, b in zip([0, *ends], ends)):
        return None
    return [[*range(a, b)] for a, b in zip([0, *ends], ends)]


def hybrid(docs: DataFrame, embed=hashed_words, target: int = 450, overlap: int = 80) -> DataFrame:
    """doc_id, mode, fell_back, ord, n_sentences, text of documents (doc_id, text, mode, ends).

    Mode agentic cuts at the sentence ends that a model gave beforehand and falls back on late ones where these
    don't cover the text; late, and any other or none, cuts by windows of sentences. Empty texts have no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, mode, ends in zip(b["doc_id"], b["text"], b["mode"], b["ends"]):
                s = split_sentences(t)
                groups = given_boundaries(ends, len(s)) if mode == "agentic" else None
                used = "late" if groups is None else "agentic"
                groups = window_boundaries(s, embed, target, overlap=overlap) if groups is None else groups
                rows += [(d, used, mode == "agentic" and used == "late", k, len(g), " ".join(s[i] for i in g)) for k, g in enumerate(groups)]
            yield pd.DataFrame(rows, columns=["doc_id", "mode", "fell_back", "ord", "n_sentences", "text"])

    return docs.select("doc_id", "text", "mode", "ends").mapInPandas(run, "doc_id long, mode string, fell_back boolean, ord int, n_sentences int, text string")


def sections(text: str | None) -> list[tuple[list[str], str]]:
    """(titles of the headings above, text) of each run of lines under the same Markdown headings."""
    out, stack, held = [], [], []

    def flush():
        if body := "\n".join(held).strip():
            out.append(([title for _, title in stack], body))
        held.clear()

    for line in (text or "").split("\n"):
        if m := HEADING.match(line):
            flush()
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2].strip()))
        else:
            held.append(line)
    flush()
    return out


def by_section(docs: DataFrame, target: int = 120, overlap: int = 20, limit: int = 200) -> DataFrame:
    """doc_id, ord, path, text: plain chunks within the sections of Markdown texts; none crosses a heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                k = 0
                for path, body in sections(t):
                    s = [p for x in split_sentences(body) for p in by_limit(x, limit)]
                    for g in pack(s, target, overlap, limit):
                        rows.append((d, k, path, " ".join(s[i] for i in g)))
                        k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "path", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ord int, path array<string>, text string")


def chunked(docs: DataFrame, mode: str = "plain", target: int = 120, overlap: int = 20, limit: int = 200) -> DataFrame:
    """doc_id, ord, n_sentences, text: every sentence of every whole text is in a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                s = split_sentences(t)
                if mode == "plain":
                    s = [p for x in s for p in by_limit(x, limit)]
                groups = pack(s, target, overlap, limit) if mode == "plain" else late_boundaries(s, target, overlap=overlap)
                rows += [(d, k, len(g), " ".join(s[i] for i in g)) for k, g in enumerate(groups)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "n_sentences", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ord int, n_sentences int, text string")


def overlap_ratio(text: Column, doc_type: Column) -> Column:
    """Share of a chunk that is repeated: 10 % for lists, more for stories and long runs of plain lines."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    base = F.when(t.rlike("story|narrative|article|report"), 0.22).otherwise(0.15) + F.when(lines > 4, 0.02).otherwise(0.0)
    return F.when((F.trim(text) == "") | t.rlike("faq|list|table|glossary"), 0.10).otherwise(F.greatest(F.lit(0.10), F.least(base, F.lit(0.25))))


def problems(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 100))
    dangling = F.lit(False)
    for p in DANGLING:
        dangling = dangling | low.startswith(p) | F.contains(F.substring(low, 1, 50), F.lit(" " + p))
    last = F.right(F.trim(text), F.lit(1))
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.array_compact(F.array(
        F.when(F.length(text) < 50, "too_short"), F.when(F.length(text) > 2000, "too_long"), F.when(dangling, "dangling_reference"),
        F.when((F.trim(text) != "") & ~last.isin(*".!?:\"'"), "incomplete_sentence"), F.when(pipes > 5, "table_fragment"),
    ))


def boundary_issues(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, issues, score (100 less 25 an issue) of each boundary to the next chunk."""
    nxt = F.trim(F.lead("text").over(Window.partitionBy(key).orderBy(order)))
    c = chunks.withColumn("_next", nxt).where(F.col("_next").isNotNull()).withColumn("_end", F.trim("text"))
    first = F.substring("_next", 1, 1)
    issues = F.array_compact(F.array(
        F.when((F.col("_end") != "") & ~F.right("_end", F.lit(1)).isin(*".!?:;"), "ends_mid_sentence"),
        F.when((F.lower(first) == first) & (F.upper(first) != first), "starts_lowercase"),
        F.when(F.col("_next").rlike("^(dieser|diese|dieses|das |dies )"), "dangling_reference"),
        F.when(F.col("_end").rlike(r"(1\.|2\.|3\.|a\)|b\))$"), "list_header_orphan"),
    ))
    return c.select(key, order, issues.alias("issues"), (100 - 25 * F.size(issues)).alias("score"))


def header(title: Column, section: Column, words: int = 14, chars: int = 140) -> Column:
    """A short context line: title and section, cut by words and characters."""
    whole = F.concat_ws(" - ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(section), F.lit("")))
    return F.substring(F.array_join(F.slice(F.split(whole, r"\s+"), 1, words), " "), 1, chars)


def with_header(text: Column, head: Column) -> Column:
    return F.when((head == "") | text.startswith(head), text).otherwise(F.concat(head, F.lit("\n\n"), text))


def lineage(chunks: DataFrame) -> DataFrame:
    """Chunks (document, ord, section) with parent ids: the document's root and its section, numbered by first appearance."""
    w = Window.partitionBy("document")
    firsts = chunks.groupBy("document", "section").agg(F.min("ord").alias("at")).withColumn("n", F.row_number().over(w.orderBy("at")))
    ids = F.array(F.concat("document", F.lit("#doc")), F.concat("document", F.lit("#s"), "n"))
    counted = chunks.withColumn("chunk_count", F.count("*").over(w))
    return counted.join(firsts.select("document", F.col("section").alias("_s"), "n"), ["document"]).where(F.col("section").eqNullSafe(F.col("_s"))).select("document", "ord", "chunk_count", ids.alias("parent_ids"))
