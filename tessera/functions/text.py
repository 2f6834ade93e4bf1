"""Text normalisation, tokens, estimates and keyword rules as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"(?U)\w+"
# Facets and the keywords that hint at them.
FACET_KEYWORDS = {
    "LEGAL": ["legal", "gesetz", "policy", "compliance", "regulation", "gdpr"],
    "TECHNICAL": ["technical", "system", "architecture", "api", "protocol"],
    "PROCEDURAL": ["process", "procedure", "workflow", "steps"],
    "DATA_CATEGORIES": ["data category", "pii", "personal data", "classification"],
    "MONITORING_SURVEILLANCE": ["monitor", "surveillance", "observe", "watch"],
    "LOGGING_AUDIT": ["audit", "logging", "log"],
    "ANALYTICS_REPORTING": ["analytics", "report", "metric", "dashboard"],
    "ACCESS_PRIVACY_SECURITY": ["privacy", "security", "access", "permission", "control"],
    "API_INTEGRATION": ["api", "integration", "endpoint", "sdk"],
}
# Document types by keyword, first match wins.
DOC_TYPE_KEYWORDS = {
    "legal_contract": ["vertrag", "agreement", "contract", "nda", "mou"],
    "policy": ["policy", "guideline", "leitlinie", "richtlinie"],
    "technical": ["spec", "specification", "api", "endpoint", "schema"],
}
# Words that ask for an extraction.
EXTRACT_INTENT = [
    "welche fragen", "welche frage", "fragen", "frage", "questions", "question", "checklist", "check list", "checkliste",
    "fields", "field", "formular", "form", "ausfuellen", "auszufuellen",
]
# Words that count as questions.
QUESTION_WORDS = [
    "frage", "fragen", "question", "questions", "which", "what", "who", "when", "why", "how", "welche", "welcher", "welches", "was",
    "wer", "wann", "warum", "wieso", "wie", "wo", "field", "fields", "formular", "form", "auszufuellen", "ausfuellen",
]


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_visible(s: pd.Series) -> pd.Series:
    """NFKC without invisible characters (controls, formats, surrogates), stripped."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKC", x) if unicodedata.category(c) not in ("Cc", "Cf", "Cs")).strip(), na_action="ignore")


#: Unicode's space separators, which a trim takes from the ends.
SPACES = "".join(chr(c) for c in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))


def collapse(text: Column) -> Column:
    r"""Runs of white space ([\t\n\f\r ]: Java's \s has \x0B too) become one space; ends are trimmed, of Unicode's spaces too."""
    return F.trim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(SPACES))


def normalise_db(text: Column) -> Column:
    """NFC, lower case, white-space runs as one space, without a trim."""
    return F.regexp_replace(F.lower(nfc(text)), r"\s+", " ")


def plural_stem(token: Column) -> Column:
    """A German plural ending goes from words of over four letters: en, n or e, with four left. Other tokens stay."""
    n = F.length(token)
    return (
        F.when((n <= 4) | ~token.rlike(r"^[\p{L}\p{N}_]+$"), token)
        .when(token.endswith("en") & (n >= 6), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("n") & ~token.endswith("en") | token.endswith("en") & (n == 5), F.substring(token, F.lit(1), n - 1))
        .when(token.endswith("e"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def normalise(text: Column) -> Column:
    """NFC, lower case, white-space runs as one space, trimmed, each word without a plural ending."""
    return F.array_join(F.transform(F.split(collapse(F.lower(nfc(text))), " "), plural_stem), " ")


def dedup_tokens(text: Column) -> Column:
    """Sorted distinct lower-case words."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))))


def dedup_fingerprint(text: Column) -> Column:
    return F.sha1(F.array_join(dedup_tokens(text), "\x1f"))


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)[\\wÀ-ɏ]+"), F.lit(0))


def websearch(text: Column) -> Column:
    """A query of alternatives: its words, without what stands between them, joined by OR."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " OR ")


def tokens_quarter(text: Column) -> Column:
    """max(1, characters div 4); 0 of an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.expr("1") * F.floor(F.length(text) / 4))).cast("int")


def tokens_words(text: Column) -> Column:
    """max(1, words)."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))).cast("int")


def token_count(text: Column) -> Column:
    """Words; a single word counts by its characters."""
    words = F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))
    return F.when(words == 1, F.length(F.trim(text))).otherwise(words).cast("int")


def simple_sentences(text: Column) -> Column:
    """Runs up to ., ! or ? with their marks, trimmed, none empty; lines where there are none."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+(?:[.!?]+|$)"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""))


def sentences(text: Column) -> Column:
    """Sentence ends that aren't inside URLs, decimals, initials, common abbreviations or list numbers."""
    guarded = F.regexp_replace(text, r"(https?://\S+)\.(?=\S)", "$1\u0001")
    guarded = F.regexp_replace(guarded, r"(?<=\d)\.(?=\d)", "\u0001")
    guarded = F.regexp_replace(guarded, r"\b([A-ZÄÖÜ])\.(?=\s)", "$1\u0001")
    guarded = F.regexp_replace(guarded, r"(?i)\b(z\.B|d\.h|u\.a|bzw|ca|vgl|Dr|Prof|Nr|Abs|Art|etc|e\.g|i\.e|Mr|Mrs|vs)\.", "$1\u0001")
    guarded = F.regexp_replace(guarded, r"(?m)^(\s*\d+)\.(?=\s)", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def list_index(line: Column) -> Column:
    """The number of a numbered list item, null for other lines."""
    return F.nullif(F.regexp_extract(line, r"^\s*(\d{1,9})[.)]\s+", 1), F.lit("")).cast("int")


def chunk_prefix(reference: Column, kind: Column, path: Column, position: Column, most: int = 200) -> Column:
    """"ref - type | path | position" of what is there, cut at `most` characters."""
    head = F.concat_ws(" - ", F.nullif(reference, F.lit("")), F.nullif(kind, F.lit("")))
    return F.substring(F.concat_ws(" | ", F.nullif(head, F.lit("")), F.nullif(path, F.lit("")), F.nullif(position, F.lit(""))), 1, most)


def reference_ids(text: Column) -> Column:
    """Distinct UUIDs after doc, document or ref, in order of appearance."""
    uuid = "([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?:doc|document|ref)[:/]{1,2}" + uuid), F.lit(1)))


def key_points(text: Column, least: int = 3, most: int = 5) -> Column:
    """Sentences of over ten characters, five at most; if under three, other lines up to three, then the last (or the text's start) again."""
    long = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    more = F.slice(F.array_except(lines, long), 1, F.greatest(F.lit(0), least - F.size(long)))
    found = F.slice(F.concat(long, more), 1, most)
    last = F.coalesce(F.get(found, F.size(found) - 1), F.substring(text, 1, 50))
    return F.concat(found, F.array_repeat(last, F.greatest(F.lit(0), least - F.size(found))))


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def facets(text: Column) -> dict[str, Column]:
    """Share of a third of a facet's keywords that occur, 1 at most."""
    low = F.lower(text)
    return {name: F.least(F.lit(1.0), sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / 3.0) for name, words in FACET_KEYWORDS.items()}


def doc_type(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in DOC_TYPE_KEYWORDS.items():
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out


def intent(text: Column) -> Column:
    return F.when(any_of(F.lower(F.trim(text)), EXTRACT_INTENT), "extract").otherwise("default")


def question_density(text: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    words = F.regexp_count(F.lower(text), F.lit("(?U)\\b(" + "|".join(sorted(QUESTION_WORDS, key=lambda w: -len(w))) + ")\\b"))
    return F.least(F.lit(1.0), (marks + words) / 3.0)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded with two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("(?U)[\\p{L}\\p{N}]+"), F.lit(0))
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, one)))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends on a character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    cut = F.regexp_replace(F.hex(raw), "(?:[C-F][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){1,2})$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))
