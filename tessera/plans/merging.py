"""Queries over equal matches and the documents of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging as mg
from .registry import query

MATCHES = """m AS (SELECT conv_id // 4 AS query_id, conv_id * 100 + turn AS n, CASE WHEN turn % 5 = 0 THEN ' k' || turn % 2 END AS chunk_id, CASE WHEN turn % 5 = 1 THEN md5(role) WHEN turn % 5 = 2 THEN ' ' END AS hash, CASE WHEN turn % 5 IN (2, 3) THEN role END AS id, CASE WHEN turn % 5 < 3 THEN left(text, 3) END AS text,
  round(1.0::double / (1 + length(text) % 3), 6) AS score, [{'k': 'turn', 'v': turn::varchar}, {'k': role, 'v': length(text)::varchar}, {'k': 'k' || turn % 3, 'v': CASE WHEN turn % 2 = 0 THEN conv_id::varchar END}] AS meta FROM conversations),
k AS (SELECT *, CASE WHEN trim(chunk_id) <> '' THEN 'c' || chr(31) || trim(chunk_id) WHEN trim(hash) <> '' THEN 'h' || chr(31) || hash WHEN id IS NOT NULL AND text IS NOT NULL THEN 'it' || chr(31) || id || chr(31) || sha256(text) WHEN id IS NOT NULL THEN 'in' || chr(31) || id || chr(31) || n ELSE 'n' || chr(31) || n END AS key FROM m),
t AS (SELECT * FROM k QUALIFY score = max(score) OVER (PARTITION BY query_id, key)), e AS (SELECT query_id, key, x.k AS name, arg_min({'v': x.v}, n) AS v FROM (SELECT query_id, key, n, unnest(meta) AS x FROM t) GROUP BY ALL),
j AS (SELECT query_id, key, string_agg(name || '=' || coalesce(v.v, '-'), ',' ORDER BY name) AS meta FROM e GROUP BY ALL), w AS (SELECT * FROM t QUALIFY n = min(n) OVER (PARTITION BY query_id, key))"""


@query("match_merge", f"WITH {MATCHES} SELECT w.query_id, w.key, w.id, w.text, w.score, j.meta, row_number() OVER (PARTITION BY w.query_id ORDER BY w.score DESC, coalesce(w.id, ''), w.key)::int AS rank FROM w JOIN j ON j.query_id = w.query_id AND j.key = w.key")
def _(t):
    k = F.col("turn")
    m = t.conversations.select(
        F.floor(F.col("conv_id") / 4).alias("query_id"), (F.col("conv_id") * 100 + k).alias("n"), F.when(k % 5 == 0, F.concat(F.lit(" k"), k % 2)).alias("chunk_id"), F.when(k % 5 == 1, F.md5("role")).when(k % 5 == 2, " ").alias("hash"), F.when((k % 5).isin(2, 3), F.col("role")).alias("id"),
        F.when(k % 5 < 3, F.substring("text", 1, 3)).alias("text"), F.round(1 / (1 + F.length("text") % 3), 6).alias("score"),
        F.create_map(F.lit("turn"), k.cast("string"), F.col("role"), F.length("text").cast("string"), F.concat(F.lit("k"), k % 3), F.when(k % 2 == 0, F.col("conv_id").cast("string"))).alias("meta"),
    )
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("-")))), ",")
    return mg.merged_matches(m).withColumn("meta", flat)


CHUNKS = """c AS (SELECT doc_id AS n, CASE WHEN doc_id % 11 > 0 THEN lang END AS tenant, CASE WHEN doc_id % 13 > 0 THEN 'h' || doc_id % 6 END AS hash, CASE doc_id % 4 WHEN 0 THEN 'w1' WHEN 1 THEN 'None' END AS workflow, CASE WHEN doc_id % 3 = 0 THEN source END AS ext,
  CASE doc_id % 5 WHEN 0 THEN '0A000000-0000-4000-8000-000000000001' WHEN 1 THEN ' c ' WHEN 2 THEN 'None' END AS coll, CASE WHEN doc_id % 2 = 0 THEN 'class' END AS class, CASE WHEN doc_id % 7 < 2 THEN '00000000-0000-4000-8000-00000000000' || doc_id % 7 WHEN doc_id % 7 = 2 THEN 'odd' END AS did,
  CASE WHEN doc_id % 9 > 0 THEN 's' || doc_id % 9 END AS src FROM documents),
k AS (SELECT n, tenant AS tenant_id, CASE WHEN workflow <> 'None' THEN workflow END AS workflow_id, coalesce(ext, hash) AS external_id, CASE WHEN coll LIKE '0A%' THEN lower(coll) ELSE coalesce(CASE WHEN coll <> 'None' THEN trim(coll) END, class) END AS collection_id, hash, coalesce(src, 'unknown') AS source, CASE WHEN did <> 'odd' THEN did END AS document_id FROM c WHERE tenant IS NOT NULL AND hash IS NOT NULL)"""


@query("document_groups", f"""WITH {CHUNKS}, g AS (SELECT tenant_id, workflow_id, external_id, collection_id, arg_min(hash, n) AS hash, arg_min(source, n) AS source, arg_min({{'d': document_id}}, n).d AS document_id, count(*) AS chunks, list({{'d': document_id}}) AS ds, arg_max(n, n) % 3 AS p FROM k GROUP BY ALL)
 SELECT tenant_id, workflow_id, external_id, collection_id, hash, source, document_id, chunks, len(list_filter(ds, lambda x: x.d IS NOT NULL AND x.d IS DISTINCT FROM document_id)) AS other_ids, 'p=' || (SELECT max(n) FROM k WHERE k.tenant_id = g.tenant_id AND k.workflow_id IS NOT DISTINCT FROM g.workflow_id AND k.external_id = g.external_id AND k.collection_id IS NOT DISTINCT FROM g.collection_id) AS parents FROM g""")
def _(t):
    i = F.col("doc_id")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    meta = F.array(
        entry("tenant" , F.when(i % 11 > 0, F.col("lang"))), entry("hash", F.when(i % 13 > 0, F.concat(F.lit("h"), i % 6))), entry("workflow_id", F.when(i % 4 == 0, "w1").when(i % 4 == 1, "None")), entry("external_id", F.when(i % 3 == 0, F.col("source"))),
        entry("collection_id", F.when(i % 5 == 0, "0A000000-0000-4000-8000-000000000001").when(i % 5 == 1, " c ").when(i % 5 == 2, "None")), entry("doc_class", F.when(i % 2 == 0, "class")),
        entry("document_id", F.when(i % 7 < 2, F.concat(F.lit("00000000-0000-4000-8000-00000000000"), i % 7)).when(i % 7 == 2, "odd")), entry("source", F.when(i % 9 > 0, F.concat(F.lit("s"), i % 9))),
    )
    chunks = t.documents.select(i.alias("n"), F.map_from_entries(F.filter(meta, lambda x: x["value"].isNotNull())).alias("meta"), F.create_map(F.lit("p"), i.cast("string")).alias("parents"))
    docs, _ = mg.grouped_chunks(chunks)
    return docs.drop("metadata").withColumn("parents", F.concat(F.lit("p="), F.col("parents")["p"]))


@query("refused_chunks", "SELECT doc_id AS n, CASE WHEN doc_id % 11 = 0 THEN 'tenant_id' ELSE 'hash' END AS reason FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0")
def _(t):
    i = F.col("doc_id")
    meta = F.create_map(F.lit("tenant_id"), F.when(i % 11 > 0, F.col("lang")).otherwise(" "), F.lit("hash"), F.when(i % 13 > 0, F.col("source")).otherwise("None"))
    return mg.grouped_chunks(t.documents.select(i.alias("n"), meta.alias("meta"), F.create_map(F.lit("p"), F.lit("x")).alias("parents")))[1]
