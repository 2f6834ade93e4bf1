"""Masks for log records, as columns: by the name of a field, by what its text looks like, by card numbers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hosts import let

MASK = "[REDACTED]"
# Parts of field names that are masked whole, fields of language models, and fields that stay.
SENSITIVE = ["email", "phone", "bearer", "api_key", "apikey", "password", "token", "secret", "authorization", "auth_header", "private_key", "client_secret"]
PROMPTS = ["prompt", "response"]
KEPT = ["@timestamp", "timestamp", "document_id", "asset_id", "trace_id", "span_id", "logging.googleapis.com/spanId"]
# Patterns of what is masked in a text, in their order, with what stands for a match.
PATTERNS = [
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", MASK),
    (r"(?m)^\s*(?:\+49(?:[ ()\-/]?\d){6,14}\d|0\d{2,5}(?:[ ()\-/]?\d){3,}\d)\s*$", MASK),
    (r"(?<!\w)(?:\+49(?:[ ()\-/]?\d){6,14}\d|0\d{2,5}(?:[ ()\-/]?\d){3,}\d)", MASK),
    (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b", MASK),
    (r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", MASK),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", MASK),
    (r"-----BEGIN PRIVATE KEY-----[\s\S]+?-----END PRIVATE KEY-----", MASK),
    (r'(?i)("type"\s*:\s*)"service_account"', '$1"[REDACTED]"'),
    (r'(?i)("client_secret"\s*:\s*)"[^"]+"', '$1\\\\"[REDACTED]\\\\"'),
    (r"\bGOCSPX-[A-Za-z0-9_-]{10,}\b", MASK),
]
# Texts that are masked whole, and what may be a card number.
WHOLE = [r"(?i)^\s*-----BEGIN PRIVATE KEY-----", r"^\s*eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\s*$", r"(?i)^\s*Bearer\s+[A-Za-z0-9\-._~+/]+=*\s*$", r"^\s*[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\s*$"]
CARD = r"\b(?:\d[ -]?){12,18}\d\b"


def keyed_hash(value: Column, salt: str) -> Column:
    """HMAC-SHA256 in hexadecimal: two digests with the salt's pads, which are constants."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def mask_cards(text: Column, mask: str = MASK) -> Column:
    """Runs of 13 to 19 digits that pass the Luhn check, with spaces or hyphens between them; each run is judged by itself."""
    valid = lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))
    shown = lambda m: F.when(valid(m), mask).otherwise(m)
    joined = F.array_join(F.zip_with(F.split(text, CARD, -1), F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), lambda a, m: F.concat(a, F.coalesce(shown(m), F.lit("")))), "")
    return F.when(text.rlike(CARD), joined).otherwise(text)


def redacted_text(text: Column) -> Column:
    """A text without what its name would tell: masked whole if it is a key, else pattern by pattern, then its card numbers."""
    whole = F.lit(False)
    for p in WHOLE:
        whole = whole | text.rlike(p)
    out = text
    for p, by in PATTERNS:
        out = F.regexp_replace(out, p, by)
    return F.when(whole, MASK).otherwise(let(out, mask_cards))


def redacted(key: Column, text: Column, salt: str = "", prompts_shown: bool = True) -> Column:
    """The text of a field: kept for names that link records, masked for names that tell a secret; prompts may be told by length and hash only."""
    low = F.lower(key)
    secret = F.lit(False)
    for word in SENSITIVE:
        secret = secret | F.contains(low, F.lit(word))
    told = F.concat(F.lit(f"{MASK} len="), F.length(text).cast("string"), F.lit(" hash="), keyed_hash(text, salt))
    out = F.when(text.isNull() | key.isin(KEPT), text)
    if not prompts_shown:
        out = out.when(low.isin(PROMPTS), told)
    return out.when(secret, MASK).otherwise(redacted_text(text))


def redacted_map(record: Column, salt: str = "", prompts_shown: bool = True) -> Column:
    """A record, a map of texts, field by field."""
    return F.transform_values(record, lambda k, v: redacted(k, v, salt, prompts_shown))
