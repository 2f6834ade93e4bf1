"""Masking of personal data and secrets."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is masked, in this order.
PATTERNS = [
    ("EMAIL", r"(?i)(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?![\w.+-])"),
    ("PHONE", r"(?<!\w)(\+?\d[\d\s().-]{5,}\d)(?!\w)"),
    ("IBAN", r"(?i)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"),
    ("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("IPV6", r"(?i)\b(?:[0-9A-F]{1,4}:){2,7}[0-9A-F]{1,4}\b"),
    ("UUID", r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b"),
    ("NUMBER", r"\b\d{3,}\b"),
]
# JSON keys and URL parameters that hold secrets.
SENSITIVE_KEYS = ["type", "client_email", "private_key_id", "private_key", "client_id", "access_token", "refresh_token"]
SENSITIVE_PARAMS = [
    "email", "phone", "token", "code", "apikey", "api_key", "api-key", "access_key", "access-key", "access_token", "access-token", "id_token",
    "client_secret", "secret", "password", "pass", "pwd", "session", "session_id", "sessionid", "sid", "auth", "authorization",
]
# A token's segments; values that look random (URL-safe, base 64, hexadecimal).
JWT = r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"

RANDOM_VALUES = ["[A-Za-z0-9_-]{20,}", "[A-Za-z0-9+/]{20,}={0,2}", "[A-Fa-f0-9]{32,}"]


# What each policy masks.
POLICIES = {
    "strict": [
        "EMAIL", "PHONE", "IBAN", "IPV4", "IPV6", "UUID", "JWT", "NUMBER", "TYPE", "CLIENT_EMAIL", "PRIVATE_KEY_ID", "PRIVATE_KEY", "CLIENT_ID",
        "ACCESS_TOKEN", "ACCESS-TOKEN", "REFRESH_TOKEN", "TOKEN", "CODE", "KEY", "APIKEY", "API_KEY", "API-KEY", "ACCESS_KEY", "ACCESS-KEY", "PASSWORD",
        "PASS", "PWD", "SECRET", "SESSION", "SESSION_ID", "SESSIONID", "SID", "ID_TOKEN", "CLIENT_SECRET", "AUTH", "AUTHORIZATION",
    ],
    "balanced": [
        "EMAIL", "PHONE", "UUID", "JWT", "TYPE", "CLIENT_EMAIL", "PRIVATE_KEY", "ACCESS_TOKEN", "ACCESS-TOKEN", "REFRESH_TOKEN", "TOKEN", "CODE", "PASSWORD",
        "SECRET", "APIKEY", "API_KEY", "API-KEY", "ACCESS_KEY", "ACCESS-KEY", "ID_TOKEN", "CLIENT_SECRET", "SESSION", "SESSION_ID", "SESSIONID", "SID", "PWD",
        "AUTH", "AUTHORIZATION",
    ],
    "lenient": ["EMAIL", "PHONE"],
}


def mask_jwt(text: Column) -> Column:
    """Each of a token's three segments by a placeholder."""
    return F.regexp_replace(text, JWT, "[REDACTED_JWT_HEADER].[REDACTED_JWT_PAYLOAD].[REDACTED_JWT_SIGNATURE]")


def mask_url_params(text: Column, only: list[str] | None = None) -> Column:
    """Values of sensitive query parameters (or only of those named) inside URLs; `key` only if its value looks random."""
    named = [n for n in SENSITIVE_PARAMS if only is None or n.upper() in only]
    names = "|".join(sorted(named, key=lambda n: (-len(n), n)))
    within = r"((?:\G(?!\A)|https?://)[^\s)]*?[?&]{}=)"  # from a URL's start, or on in the URL of the last match
    once = text if not named else F.regexp_replace(text, "(?i)" + within.format(f"(?:{names})") + r"(?!\[REDACTED)[^&#\s)]+", "$1[REDACTED]")
    return once if only is not None and "KEY" not in only else F.regexp_replace(once, within.format("(?i:key)") + f"(?:{'|'.join(RANDOM_VALUES)})" + r"(?=[&#\s)]|$)", "$1[REDACTED]")


def mask(text: Column, numbers: bool = False, only: list[str] | None = None) -> Column:
    """Tokens, URL parameters, then the patterns in order, by [REDACTED_TAG]; numbers only if asked for."""
    out = mask_url_params(mask_jwt(text)) if only is None else text
    for tag, pattern in PATTERNS:
        if (only is None or tag in only) and (numbers or tag != "NUMBER"):
            out = F.transform(F.array(out), lambda x: F.when(may_have(x, tag), F.regexp_replace(x, pattern, f"[REDACTED_{tag}]")).otherwise(x))[0]
    return out


def mask_by_policy(text: Column, policy: str) -> Column:
    """What a policy names, numbers included if it names them; an unknown policy is the balanced one."""
    rules = POLICIES.get(policy, POLICIES["balanced"])
    return mask(mask_url_params(mask_jwt(text) if "JWT" in rules else text, rules), numbers=True, only=rules)


def may_have(text: Column, tag: str) -> Column:
    """A cheap test that holds for any text with the pattern of this tag: most texts skip the costly search."""
    mark = {"EMAIL": "@", "IPV6": ":", "UUID": "-"}.get(tag)
    return F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9]" if tag == "IBAN" else "\\d")


def counts(text: Column) -> dict[str, Column]:
    return {tag: F.when(may_have(text, tag), F.regexp_count(text, F.lit(p))).when(text.isNotNull(), 0) for tag, p in PATTERNS}


def digits_if_unmasked(text: Column, masked: Column) -> Column:
    """Where nothing was masked, every digit becomes X."""
    return F.when(masked == text, F.regexp_replace(text, "[0-9]", "X")).otherwise(masked)


def pseudonyms(key: str):
    """E-mail addresses by <EMAIL_ and eight hex digits of an HMAC>: the same input, the same name."""
    import re

    pattern = re.compile(PATTERNS[0][1])
    name = lambda m: "<EMAIL_" + hmac.new(key.encode(), m[0].lower().encode(), hashlib.sha256).hexdigest()[:8] + ">"

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pattern.sub(name, x), na_action="ignore")

    return run


@F.pandas_udf(StringType())
def mask_json(s: pd.Series) -> pd.Series:
    """JSON objects with the values of sensitive keys masked at any depth; `type` only of service accounts."""

    def walk(x, key=None, account=False):
        if isinstance(x, dict):
            account = "private_key" in x or x.get("type") == "service_account"
            return {k: walk(v, k, account) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, key, account) for v in x]
        if key in SENSITIVE_KEYS and (key != "type" or account) and x is not None:
            return "[REDACTED]"
        return x

    def one(x):
        try:
            return json.dumps(walk(json.loads(x)), ensure_ascii=False)
        except ValueError:
            return x

    return s.map(one, na_action="ignore")


def mask_cards(text: Column) -> Column:
    """Digit groups of 13 to 19 digits that pass the Luhn check."""
    found = F.regexp_extract_all(text, F.lit(r"\b(?:\d[ -]?){12,18}\d\b"), F.lit(0))
    valid = F.filter(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))
    return F.aggregate(valid, text, lambda out, c: F.replace(out, c, F.lit("[REDACTED_CARD]")))
