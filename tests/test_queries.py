"""Every query of the engine's own plans against its SQL, on the smallest tables."""

import importlib

import duckdb
import pytest

from tessera.plans import registry

for module in ("access", "assessment", "content", "documents", "lookups", "merging", "policy", "relational", "retrieval", "scalars", "scoped", "search", "text"):
    importlib.import_module(f"tessera.plans.{module}")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([canonical(r[c]) for c in columns]) for r in df.collect())
    if name in registry.ORACLE_SQL:
        q = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        assert sorted(repr([canonical(r[names.index(c)]) for c in columns]) for r in q.fetchall()) == rows
