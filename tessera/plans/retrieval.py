"""Queries over context around matches, and retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..operators import retrieval as re_
from .registry import query
from .scoped import ASKED, CHUNKS, HELD, SHOWN, asked, chunks, leg_sql

#: Turns of a conversation as its matches: two documents, sections of one or two levels, an order of their own.
MATCHES = """m AS (SELECT conv_id AS query_id, turn AS id, turn % 2 AS doc, CASE WHEN turn % 5 = 3 THEN [role, 'x'] ELSE [role] END AS section, turn * 7 % 5 AS ord, round(1.0::double / (1 + length(text) % 7), 6) AS score, text, turn AS n FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k, CASE WHEN text <> '' THEN greatest(1, length(text) // 4) ELSE 0 END AS tokens, regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+') AS w, lag({'n': n, 'id': id, 't': greatest(1, length(text) // 4)}) OVER s AS before, lead({'n': n, 'id': id, 't': greatest(1, length(text) // 4)}) OVER s AS after_,
  lag(id) OVER d AS dbefore, lead(id) OVER d AS dafter FROM m WINDOW s AS (PARTITION BY query_id, doc, section ORDER BY ord, id), d AS (PARTITION BY query_id, doc ORDER BY n, id)),
a AS (SELECT *, list_sort(list_filter([before, after_], lambda x: x IS NOT NULL)) AS near, trim(text, ' \t\n\r') <> '' AND length(trim(text, ' \t\n\r')) <= 220 AND NOT contains(text, '?') AND len(w) <= 30 AND (suffix(trim(text, ' \t\n\r'), ':') OR len(section) <= 1 AND len(w) <= 20) AS title FROM b)"""
EXPANDED = MATCHES + """, c AS (SELECT query_id, id, k, list_transform(near, lambda x: x.id) AS s, CASE WHEN title THEN list_filter([dbefore, dafter], lambda x: x IS NOT NULL) ELSE [] END AS t FROM a),
r AS (SELECT DISTINCT query_id, 0::bigint AS k, []::bigint[] AS ids FROM m UNION ALL SELECT r.query_id, r.k + 1, CASE WHEN list_contains(ids, c.id) THEN ids ELSE list_concat(ids, [c.id], list_filter(list_concat(s, list_filter(t, lambda x: NOT list_contains(s, x))), lambda x: NOT list_contains(ids, x))) END FROM r JOIN c ON c.query_id = r.query_id AND c.k = r.k + 1),
e AS (SELECT query_id, id, pos - 1 AS pos FROM (SELECT query_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (SELECT query_id, arg_max(ids, k) AS ids FROM r GROUP BY query_id)))"""


def matches(t):
    c, k = t.conversations, F.col("turn")
    return c.select(
        F.col("conv_id").alias("query_id"), k.alias("id"), (k % 2).alias("doc"), F.when(k % 5 == 3, F.array("role", F.lit("x"))).otherwise(F.array("role")).alias("section"), (k * 7 % 5).alias("ord"),
        F.round(1 / (1 + F.length("text") % 7), 6).alias("score"), "text", k.alias("n"), tx.tokens_quarter(F.col("text")).alias("tokens"),
    )


@query("context_expansion", f"WITH RECURSIVE {EXPANDED} SELECT query_id, id, pos FROM e")
def _(t):
    return cx.expanded(matches(t))


@query("context_selection", f"""WITH RECURSIVE {EXPANDED}, o AS (SELECT e.query_id, e.id, tokens, row_number() OVER w AS rank, sum(tokens) OVER w AS used_tokens FROM e JOIN a USING (query_id, id) WHERE tokens > 0 WINDOW w AS (PARTITION BY e.query_id ORDER BY query_id % 3 = doc DESC, CASE WHEN query_id % 3 = doc THEN ord END, pos))
 SELECT query_id, id, rank::int AS rank, tokens::int AS tokens, used_tokens::bigint AS used_tokens FROM o WHERE used_tokens <= 400""")
def _(t):
    m = matches(t)
    primary = m.select("query_id").distinct().where("query_id % 3 < 2").select("query_id", (F.col("query_id") % 3).alias("doc"))
    return cx.within_budget(m, 400, primary)


@query("passage_assembly", f"""WITH RECURSIVE {MATCHES}, r AS (SELECT DISTINCT query_id, 0::bigint AS k, []::bigint[] AS used, NULL::bigint AS passage_id, []::struct(n bigint, id bigint)[] AS parts FROM m UNION ALL
 SELECT query_id, k, CASE WHEN taken THEN used ELSE list_concat(used, list_transform(now, lambda x: x.id)) END, CASE WHEN NOT taken THEN id END, CASE WHEN NOT taken THEN list_sort(now) END FROM (SELECT *, list_concat([{{'n': n, 'id': id}}], CASE WHEN one THEN [{{'n': f[1].n, 'id': f[1].id}}] ELSE [] END, CASE WHEN len(f) > 1 AND rest > 0 AND f[2].t <= rest THEN [{{'n': f[2].n, 'id': f[2].id}}] ELSE [] END) AS now FROM
 (SELECT *, lft - CASE WHEN one THEN f[1].t ELSE 0 END AS rest FROM (SELECT *, len(f) > 0 AND lft > 0 AND f[1].t <= lft AS one FROM (SELECT r.query_id, r.k + 1 AS k, r.used, a.id, a.n, list_contains(r.used, a.id) AS taken, 120 - a.tokens AS lft, list_filter(a.near, lambda x: NOT list_contains(r.used, x.id)) AS f FROM r JOIN a ON a.query_id = r.query_id AND a.k = r.k + 1)))))
 SELECT query_id, passage_id, ids, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id::varchar)::int AS rank FROM (SELECT r.query_id, passage_id, list_transform(any_value(parts), lambda x: x.id) AS ids, trim(string_agg(a.text, e'\\n\\n' ORDER BY a.n), e' \\t\\n\\r') AS text, max(a.score) AS score
  FROM r JOIN a ON a.query_id = r.query_id AND list_contains(list_transform(r.parts, lambda x: x.id), a.id) WHERE passage_id IS NOT NULL GROUP BY 1, 2) WHERE text <> ''""")
def _(t):
    return cx.passages(matches(t), 120)


VARIANTS = "list_filter(['', ' overview', ' key facts'], lambda x: trim(q) <> '')"
MORE = "list_filter(['', ' overview', ' key facts', ' background', ' general principles'], lambda x: trim(q) <> '')"


def round_sql(n: int, of: str, suffixes: str, min_sim: float, top_k: int) -> str:
    """One round as common tables whose names end with its number: variants, legs, fusion, one row a chunk, confidence."""
    legs = leg_sql(SHOWN, f"_{n}").replace("FROM asked a", f"FROM asked_{n} a").replace("JOIN words w", f"JOIN words_{n} w").replace("JOIN held h", "JOIN held h")
    words = HELD.split(", held AS")[0].replace("words AS", f"words_{n} AS").replace("FROM asked", f"FROM asked_{n}")
    return f"""asked_{n} AS (SELECT * REPLACE (query_id * 10 + i - 1 AS query_id, trim(q) || x AS q) FROM (SELECT *, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT *, {suffixes} AS s FROM {of}))),
{words}, {legs},
f_{n} AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, vrank, lrank, max((vrank IS NOT NULL)::int) OVER w AS hv, max((lrank IS NOT NULL)::int) OVER w AS hl FROM vec_{n} v FULL JOIN lex_{n} l ON v.query_id = l.query_id AND v.id = l.id WINDOW w AS (PARTITION BY coalesce(v.query_id, l.query_id))),
fused_{n} AS (SELECT query_id, id, vrank, lrank, round(least(1.0, coalesce(CASE hl WHEN 1 THEN 0.7 ELSE 1 END / (60 + vrank) * 61, 0) + coalesce(CASE hv WHEN 1 THEN 0.3 ELSE 1 END / (60 + lrank) * 61, 0)), 9)::double AS fused FROM f_{n}),
hits_{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vrank NULLS LAST, lrank NULLS LAST, id) AS rank FROM fused_{n} WHERE fused >= {min_sim} QUALIFY rank <= {top_k}),
one_{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id // 10 AS query_id, id, max(fused) AS score, list_sort(list(DISTINCT query_id % 10)) AS variants FROM hits_{n} GROUP BY 1, 2) QUALIFY rank <= {top_k}),
sure_{n} AS (SELECT query_id, round(coalesce(s[1], 0), 6) AS top, round(coalesce(CASE WHEN len(s) < 2 THEN s[1] ELSE s[1] - s[len(s)] END, 0), 6) AS delta FROM {of} LEFT JOIN (SELECT query_id, list_slice(list(score ORDER BY score DESC), 1, 3) AS s FROM one_{n} GROUP BY query_id) USING (query_id))"""


ROUNDS = f"""WITH {CHUNKS}, {ASKED}, held AS{HELD.split(', held AS')[1]}, {round_sql(0, 'asked', VARIANTS, 0.15, 5)},
low AS (SELECT asked.* FROM asked JOIN sure_0 USING (query_id) WHERE top < 0.65 OR delta < 0.05), {round_sql(1, 'low', MORE, 0.075, 7)},
got AS (SELECT *, 0 AS round FROM one_0 WHERE query_id NOT IN (SELECT query_id FROM low) UNION ALL SELECT *, 1 FROM one_1)"""


@query("retrieval_rounds", ROUNDS + " SELECT query_id, id, score, variants::int[] AS variants, round::int AS round, rank::int AS rank FROM got")
def _(t):
    return re_.retrieve(asked(t), chunks(t)).matches.select("query_id", "id", "score", "variants", "round", "rank")


@query("retrieval_conduct", ROUNDS + ", c AS (SELECT query_id, 0 AS round, top, delta, top < 0.65 OR delta < 0.05 AS again FROM sure_0 UNION ALL SELECT query_id, 1, top, delta, false FROM sure_1) SELECT query_id, round::int AS round, top::double AS top, delta::double AS delta, again FROM c")
def _(t):
    return re_.retrieve(asked(t), chunks(t)).conduct


ANSWERED = ROUNDS + """, m AS (SELECT got.*, id // 50 AS doc, id % 50 AS ord FROM got), l AS (SELECT query_id, arg_min(doc, rank) AS lead_ FROM (SELECT *, count(*) OVER (PARTITION BY query_id, doc) AS n FROM m) WHERE n >= 2 GROUP BY query_id),
 p AS (SELECT m.*, coalesce(doc = lead_, false) AS prim, sum(coalesce(doc = lead_, false)::int) OVER (PARTITION BY m.query_id) AS np FROM m LEFT JOIN l USING (query_id))
 SELECT query_id, id, score, final, r::int AS rank, round::int AS round FROM (SELECT *, round(score, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY prim DESC, CASE WHEN prim THEN ord END, round(score, 6) DESC, id) AS r FROM p) WHERE r <= greatest(3, np)"""


@query("retrieval_answers", ANSWERED)
def _(t):
    held = chunks(t).withColumns({"document_id": F.floor(F.col("id") / 50), "ord": F.col("id") % 50})
    return re_.answered(asked(t), held).select("query_id", "id", "score", "final", "rank", "round")


@query("query_planning", """WITH p AS (SELECT doc_id, lang, left(text, 40) AS q, CASE WHEN doc_id % 4 = 0 THEN 'policy' END AS doc_class, CASE WHEN contains(lower(left(text, 40)), 'spec') OR contains(lower(left(text, 40)), 'api') OR contains(lower(left(text, 40)), 'endpoint') OR contains(lower(left(text, 40)), 'schema') THEN 'technical' END AS said,
  CASE WHEN contains(lower(left(text, 40)), 'policy') OR contains(lower(left(text, 40)), 'guideline') OR contains(lower(left(text, 40)), 'leitlinie') OR contains(lower(left(text, 40)), 'richtlinie') THEN 'policy' END AS rule, CASE WHEN regexp_matches(lower(left(text, 40)), 'vertrag|agreement|contract|nda|mou') THEN 'legal_contract' END AS law FROM documents WHERE trim(text) <> '' AND doc_id % 20 = 0),
 k AS (SELECT *, coalesce(doc_class, law, rule, said) AS kind FROM p) SELECT doc_id AS query_id, CASE WHEN kind IS NULL THEN [trim(q, ' ')] ELSE [trim(q, ' '), trim(q || ' ' || replace(kind, '_', ' '), ' ')] END AS queries, kind AS doc_type, ['must'] AS must_include, CASE WHEN doc_id % 40 = 0 THEN ['c' || lang] ELSE ['c' || lang, 'x'] END AS collections, ['d' || doc_id] AS document_ids FROM k""")  # fmt: skip
def _(t):
    i = F.col("doc_id")
    q = t.documents.where("trim(text) <> '' and doc_id % 20 = 0").select(
        i.alias("query_id"), F.substring("text", 1, 40).alias("q"), F.when(i % 4 == 0, " policy ").otherwise(" ").alias("doc_class"), F.array(F.lit(" must "), F.lit(" ")).alias("must_include"), F.concat(F.lit("c"), "lang").alias("filter_collection"),
        F.when(i % 40 == 0, F.concat(F.lit("C"), "lang")).otherwise("x").alias("context_collection"), F.concat(F.lit("d"), i).alias("document_id"),
    )
    return re_.query_plan(q)


@query("query_variants", "WITH q AS (SELECT item_id, trim(text, ' ') AS q FROM benchmark WHERE trim(text, ' ') <> ''), v AS (SELECT item_id, [q, q || ' overview', q || ' key facts'] AS first, [q, q || ' overview', q || ' key facts', q || ' background', q || ' general principles'] AS again FROM q) SELECT item_id, first, again FROM v")
def _(t):
    b = t.benchmark.where("trim(text) <> ''")
    return b.select("item_id", re_.variants(F.col("text")).alias("first"), re_.variants(F.col("text"), True).alias("again"))
