"""Queries on odd tables against their SQL."""

import importlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.plans import registry

for module in ("scalars", "text"):
    importlib.import_module(f"tessera.plans.{module}")


def both(spark, folder, name, **tables):
    """A query's rows and its SQL's on made tables, sorted."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())


TEXTS = ["", " \t\n", None, "a\x0bb", "a b", "\x0b", "\x0b a", "a\xa0", "a　 ", "a", " a", "a\x85b", "a ", "a\f b\r\n", "\x1fa\x1c", "", None]


@pytest.mark.parametrize("name", ["doc_content_hash", "storage_hash"])
def test_hashes(spark, tmp_path, name):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got, want = both(spark, tmp_path, name, documents=documents)
    assert got == want


def test_six_decimals(spark, tmp_path):
    ties = [k / 2**7 for k in range(-300, 300, 7)] + [k / 2**20 for k in range(1, 3000, 37)]
    near = [(k + 0.5) * 1e-6 for k in range(400)] + [1 - 1e-9, -1 + 1e-7, 12345.9999999, -1e-9, -0.0, 0.0, 1e-300, 7e15 + 0.5, 1e22, -1.2345678901e30, 2.0**53, 2.0**63, 2.0**64 + 2.0**13, -(2.0**40) - 2**-12]
    df = spark.createDataFrame([(x,) for x in ties + near], "x double")
    assert [r[0] for r in df.select(vectors.six_decimals(F.col("x"))).collect()] == ["%.6f" % x for x in ties + near]
    odd = [ties[:64], near, [float("nan"), float("inf"), float("-inf"), 3.5], [], None, [None, 1.0]]
    got, want = both(spark, tmp_path, "vector_literal", embeddings=spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>"))
    assert got == want
