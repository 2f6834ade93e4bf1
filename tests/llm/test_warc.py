import random

import duckdb
import pytest

from tessera.llm import warc

SCHEMA = "record_id long, url string, at long, status int, etag string, last_modified string, digest string, headers map<string,string>, found string"


def test_resolution(spark):
    h = {"date": "1", "content-length": "9", "x": "old"}
    rows = [
        (1, "http://www.A.org/x/?b=2&a=1&utm_source=q#f", 10, 200, '"e"', None, "d1", h, ""),
        (2, "https://a.org:443/x?a=1&b=2", 20, 304, 'W/"e"', None, None, {"date": "2", "content-length": "0"}, ""),
        (3, "https://a.org/x?a=1&b=2", 10, 304, '"e"', None, None, {}, ""),
        (4, "https://a.org/x?a=1&b=2", 30, 200, None, "mon", "d4", None, ""),
        (5, "https://a.org/x?a=1&b=2", 40, 304, '"e"', "mon", None, None, ""),
        (6, "https://a.org/x?a=1&b=2", 40, 304, None, "tue", None, None, ""),
        (7, "https://a.org/x?a=1&b=2", 40, 304, None, None, None, {"y": "new"}, ""),
        (8, None, 40, 304, None, None, None, None, ""),
        (9, "https://a.org/x?a=1&b=2", None, 304, None, None, None, None, ""),
        (10, "not a url", 50, 304, None, None, None, None, ""),
        (11, "https://a.org/x?a=1&b=2", 99, 404, None, None, None, None, ""),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        2: ("resolved", 1), 3: ("no response", None), 5: ("resolved", 4), 6: ("validator mismatch", None), 7: ("resolved", 4),
        8: ("no response", None), 9: ("no response", None), 10: ("no response", None),
    }
    assert got[2].headers == {"date": "2", "content-length": "9", "x": "old"} and got[2].canonical_url == "a.org/x?a=1&b=2"
    assert got[7].headers == {"y": "new"} and got[5].digest == "d4"
    full = warc.with_payloads(warc.resolve(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(rows, SCHEMA).withColumnRenamed("found", "payload"), "payload")
    assert full.count() == len(got)
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("slices", [1, 3, 1000])
def test_as_of_against_brute_force(spark, slices):
    r = random.Random(slices)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), r.randint(0, 60), r.random() < 0.4, i) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, at long, is_response boolean, id long")
    df = df.selectExpr("*", "CASE WHEN is_response THEN struct(id) END AS response")
    for x in warc.latest_before(df, slices).collect():
        earlier = [(at, i) for u, at, full, i in rows if full and u == x.url and at < x.at]
        assert (x.found.id if x.found else None) == (max(earlier)[1] if earlier else None)


def test_pages_against_sql(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    got = warc.revisits(spark.read.parquet(path))
    want = con.execute(warc.SQL).fetchall()
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "resolved" in {w[2] for w in want}


def test_the_query_meets_responses_that_come_later(spark):
    """Some revisits lie between two responses of their URL: the latest earlier one isn't the latest of all."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = warc.crawl(pages).withColumn("u", warc.canonical_url(warc.F.col("url"))).collect()
    later = [r for r in rows if r.status == 304 and any(x.status == 200 and x.u == r.u and x.at > r.at for x in rows)]
    assert later


def test_repeated_records_and_one_wrong_date(spark):
    one = (1, "http://a.org/x", 10, 200, '"e"', None, "d", {"x": "1"}, "")
    rows = [one, one, (2, "http://a.org/x", 20, 304, '"e"', None, None, None, ""), (2, "http://a.org/x", 20, 304, '"e"', None, None, None, ""), (3, "http://a.org/x", 10**15, 304, '"e"', None, None, None, "")]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.record_id, r.outcome, r.response_id) for r in sorted(got)] == [(2, "resolved", 1), (2, "resolved", 1), (3, "resolved", 1)]
