"""Redaction against the standard library's regular expressions, and hashes against hmac."""

import hashlib
import hmac
import random
import re

from pyspark.sql import functions as F

from tessera.functions import redaction as rd

PIECES = [
    "plain words", "a.b@x-y.org", "A@B.CO", "+49 170 1234567", "0301234567", "DE89370400440532013000", "bearer abc.DEF~1==", "eyJabcdefghij1.abcdefghij2.abcdefghij3", "-----BEGIN PRIVATE KEY-----\nxx\n-----END PRIVATE KEY-----", '{"type": "service_account"}',
    '"client_secret" : "s3cret"', "GOCSPX-abcdefghijk", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "12345", "\n", " ", "00000000000000", "x4111111111111111", "é4111111111111111",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plainly(key, text, salt, shown):
    if key in rd.KEPT:
        return text
    if not shown and key.lower() in rd.PROMPTS:
        return f"{rd.MASK} len={len(text)} hash={hmac.new(salt.encode(), text.encode(), hashlib.sha256).hexdigest()}"
    if any(w in key.lower() for w in rd.SENSITIVE) or any(re.search(p, text) for p in rd.WHOLE):
        return rd.MASK
    for p, by in rd.PATTERNS:
        text = re.sub(p, by.replace("$1", r"\1").replace('\\\\"', '\\\\"'), text)
    return re.sub(rd.CARD, lambda m: rd.MASK if luhn(re.sub("[^0-9]", "", m[0])) else m[0], text)


def test_records(spark):
    r = random.Random(1)
    keys = ["message", "user_email", "API_KEY_x", "trace_id", "prompt", "Response", "note"]
    rows = [(i, r.choice(keys), r.choice(["", " ", ", "]).join(r.choice(PIECES) for _ in range(r.randint(1, 4)))) for i in range(800)] + [(900 + i, "note", p) for i, p in enumerate(PIECES)]
    rows = [(i, k, t) for i, k, t in rows if not re.search("é4", t)]  # what is a word character differs for letters beyond ASCII
    df = spark.createDataFrame(rows, "i int, k string, t string")
    for salt, shown in (("s", False), ("", True)):
        got = {x.i: x.v for x in df.select("i", rd.redacted(F.col("k"), F.col("t"), salt, shown).alias("v")).collect()}
        wrong = [(k, t, got[i], plainly(k, t, salt, shown)) for i, k, t in rows if got[i] != plainly(k, t, salt, shown)]
        assert not wrong, wrong[:3]
    one = spark.createDataFrame([({"note": "4111111111111111", "token": "x", "n": None},)], "m map<string,string>")
    assert one.select(rd.redacted_map(F.col("m")).alias("m")).first().m == {"note": rd.MASK, "token": rd.MASK, "n": None}


def test_keyed_hash(spark):
    df = spark.createDataFrame([("",), ("abc",), ("äß" * 100,), (None,)], "t string")
    for salt in ("", "salt", "x" * 64, "long " * 40):
        want = [hmac.new(salt.encode(), t.encode(), hashlib.sha256).hexdigest() if t is not None else None for t in ("", "abc", "äß" * 100, None)]
        assert [r.h for r in df.select(rd.keyed_hash(F.col("t"), salt).alias("h")).collect()] == want
