"""Canonical URLs against the standard library's parts, and international hosts against RFC 3492 and the idna codec."""

import posixpath
from urllib.parse import parse_qsl, urlencode, urlsplit

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hosts, urls

#: Samples of RFC 3492, section 7.1 (in lower case).
SAMPLES = {
    "ليهمابتكلموشعربي؟": "egbpdaj6bu4bxfgehfvwxn", "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye", "他們爲什麽不說中文": "ihqwctvzc91f659drss3x8bo0yb", "pročprostěnemluvíčesky": "proprostnemluvesky-uyb24dma41a",
    "למההםפשוטלאמדבריםעברית": "4dbcagdahymbxekheh6e0a7fei0b", "なぜみんな日本語を話してくれないのか": "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa", "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l", "porquénopuedensimplementehablarenespañol": "porqunopuedensimplementehablarenespaol-fmd56a",
    "tạisaohọkhôngthểchỉnóitiếngviệt": "tisaohkhngthchnitingvit-kjcr8268qyxafd2f1b9g", "3年b組金八先生": "3b-ww4c5e180e575a65lsy2b", "安室奈美恵-with-super-monkeys": "-with-super-monkeys-pc58ag80a8qai00g7n9n", "そのスピードで": "d9juau41awczczp",
}


def test_rfc_samples(spark):
    df = spark.createDataFrame([(k,) for k in SAMPLES], "label string")
    assert {r.label: r.e for r in df.select("label", hosts.encoded(F.col("label")).alias("e")).collect()} == SAMPLES


def test_hosts_against_the_codec(spark):
    names = ["example.com", "EXAMPLE.com", "bücher.example", "BÜCHER.Example", "faß.de", "σοφός.gr", "a。b", "日本語.jp", "x.日本語", "é" * 70 + ".de", "é..de", "é.", "mañana.com", "a-é-b.ü", "😀.la"]

    def codec(h):
        try:
            return h.encode("idna").decode().lower()
        except UnicodeError:
            return h.lower()

    df = spark.createDataFrame([(h,) for h in names], "h string")
    assert {r.h: r.a for r in df.select("h", hosts.ascii_host(F.col("h")).alias("a")).collect()} == {h: codec(h) if any(ord(c) > 127 for c in h) else h.lower() for h in names}


def plainly(url):
    url = (url or "").strip()
    if not url:
        return None, "source_empty"
    parts = urlsplit(url)
    if not parts.scheme:
        return None, "scheme_missing"
    if parts.scheme.lower() not in ("http", "https"):
        return None, "unsupported_scheme"
    if not parts.hostname:
        return None, "host_missing"
    try:
        port = parts.port
    except ValueError:
        return None, "port_invalid"
    port = None if (parts.scheme, port) in (("http", 80), ("https", 443)) else port
    p = parts.path
    path = posixpath.normpath(p) if p else "/"
    path = path + "/" if p.endswith("/") and not path.endswith("/") else path
    path = "/" if path == "//" else path
    kept = []
    for name, value in parse_qsl(parts.query, keep_blank_values=True):
        name = name.strip()
        if name and name.lower() not in urls.TRACKING_NAMES and not any(name.lower().startswith(x) for x in urls.TRACKING_PREFIXES):
            kept.append((name.lower(), name, value))
    query = urlencode([(n, v) for _, n, v in sorted(kept)])
    return f"{parts.scheme.lower()}://{parts.hostname}{f':{port}' if port else ''}{path}{'?' + query if query else ''}", None


piece = st.sampled_from(["a", "B", ".", "..", "/", "//", "é", "%20", "+", "~", "*", "x y", "-"])
param = st.sampled_from(["a=1", "B=2", "b=3", "utm_source=x", "REF=1", "mc_x=", "q", "q=", "=v", "a%20b=c+d", "é=ü", "&", "n=%", "p=%zz%C3%A9", "x=*~", " s =1", "a=b=c"])


def made():
    path = st.lists(piece, max_size=7).map("".join)
    query = st.lists(param, max_size=5).map("&".join)
    return st.builds(lambda s, u, h, p, path, q, f: f"{s}://{u}{h}{p}/{path}{'?' + q if q else ''}{f}", st.sampled_from(["http", "HTTPS", "http"]), st.sampled_from(["", "u:p@", "u@"]), st.sampled_from(["Example.COM", "a.b"]), st.sampled_from(["", ":80", ":443", ":8080", ":"]), path, query, st.sampled_from(["", "#f", "#"]))


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_canonical_form(spark, data):
    rows = [data.draw(made()) for _ in range(300)] + ["", None, "  ", "no scheme", "ftp://x/y", "http://", "http:///x", "mailto:a@b", "http://h:99999/", "http://h:x/", " https://h/a/ ", "http://h", "http://h?a=1", "http://[::1]:80x/", "//h/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i long, u string")
    got = {r.i: (r.c, r.e) for r in df.select("i", urls.canonical_source(F.col("u")).alias("c"), urls.canonical_error(F.col("u")).alias("e")).collect()}
    wrong = [(u, got[i], plainly(u)) for i, u in enumerate(rows) if u != "http://[::1]:80x/" and got[i] != plainly(u)]
    assert not wrong, wrong[:5]
