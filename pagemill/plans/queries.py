"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.text import ellipsize, margin_key, normalise, safe_name, slug, token_estimate
from ..operators import analysis as an
from ..operators.phrases import find_phrases
from ..sources.tables import book_pages, csv_cell, lines, links, table, tsv_cell
from . import areas, layout, markup, records, structure
from .fixtures import CASE_LINES, NORM, case_lines, clause_lines


def _refs(spark, d):
    s = table(spark, d, "supplier")
    return s.selectExpr("cast(s_suppkey % 2 as int) as doc_id", "s_suppkey as ref_id", "concat(s_nationkey % 5 + 1, '.', s_nationkey + 1, '.', s_suppkey) as number")


def _two_books(clauses):
    """The same clauses as a second document, on later pages."""
    own = clauses.select("doc_id", "number", "page_no")
    return own.unionByName(own.select((F.col("doc_id") + 1).alias("doc_id"), "number", (F.col("page_no") + 100).alias("page_no")))


def _hits(spark, d):
    found = find_phrases(table(spark, d, "documents"), "of the")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("char_start").alias("first"), F.max("char_start").alias("last"))


def _points(spark, d):
    # Some line numbers occur twice in an order.
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("e"))
    return one.selectExpr("l_orderkey as key", "l_linenumber as ord", "q as x", "cast(floor(e / 1000) as double) as y")


KIND = "CASE key % 4 WHEN 0 THEN 'Distance' WHEN 1 THEN 'Perimeter' WHEN 2 THEN 'Note' ELSE 'Area' END"

QUERIES = structure.QUERIES | layout.QUERIES | markup.QUERIES | areas.QUERIES | records.QUERIES | {
    "phrase_hits": _hits,
    "repeated_lines": lambda s, d: an.repeated_lines(book_pages(table(s, d, "documents")), 0.1),
    "margin_keys": lambda s, d: lines(table(s, d, "documents")).groupBy(margin_key(normalise(F.col("text"))).alias("line_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "clause_tree": lambda s, d: an.clauses(case_lines(s, d)),
    "reference_targets": lambda s, d: an.resolve_references(_refs(s, d), _two_books(an.clauses(clause_lines(s, d)))),
    "page_ranges": lambda s, d: an.page_ranges(table(s, d, "events").selectExpr("user_id", "day(ts) as page"), "user_id", "page"),
    "polyline_measures": lambda s, d: an.polyline_measures(_points(s, d)),
    "caption_anchors": lambda s, d: an.caption_anchors(_points(s, d).withColumn("kind", F.expr(KIND))).select("key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
    "latest_version": lambda s, d: an.latest(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value"),
    "thread_counts": lambda s, d: an.thread_counts(table(s, d, "conversations")),
    "exact_duplicates": lambda s, d: an.exact_duplicates(table(s, d, "documents")),
    "page_links": lambda s, d: links(table(s, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("target").alias("n_targets")),
    "token_estimates": lambda s, d: table(s, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"), ellipsize(normalise(F.col("text"))).alias("title")),
    "names_and_cells": lambda s, d: table(s, d, "pages").select("page_id", slug(F.col("url")).alias("slug"), safe_name(F.col("url")).alias("file"), csv_cell(F.col("html")).alias("csv"), tsv_cell(F.col("html")).alias("tsv")),
    "catalog_changes": lambda s, d: an.catalog_changes(
        table(s, d, "documents").selectExpr("doc_id as path", "md5(lang || source) as hash"), table(s, d, "documents").selectExpr("doc_id + 7 as path", "md5(lang || source) as hash")
    ),
}

ORACLES = structure.ORACLES | layout.ORACLES | markup.ORACLES | areas.ORACLES | records.ORACLES | {
    "repeated_lines": f"""WITH p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, text FROM documents),
 n AS (SELECT book, count(*) AS n_pages FROM p WHERE {NORM.format('text')} <> '' GROUP BY 1),
 l AS (SELECT book, page_no, {NORM.format('line')} AS line FROM (SELECT book, page_no, unnest(string_split(text, chr(10))) AS line FROM p)),
 c AS (SELECT book, line, count(DISTINCT page_no) AS on_pages FROM l WHERE line <> '' GROUP BY 1, 2)
 SELECT book, line, on_pages, n_pages FROM c JOIN n USING (book) WHERE n_pages >= 4 AND on_pages >= greatest(3, ceil(n_pages * 0.1))""",
    "margin_keys": f"""SELECT regexp_replace({NORM.format('l')}, '[0-9]+', '#', 'g') AS line_key, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1 HAVING count(*) > 1""",
    "phrase_hits": """WITH m AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?i)of\\s+the')) AS n FROM documents WHERE regexp_matches(text, '(?i)of\\s+the'))
 SELECT doc_id, n, length(regexp_replace(text, '(?is)of\\s+the.*$', '')) AS first, length(regexp_extract(text, '(?is)^(.*)of\\s+the', 1)) AS last FROM m""",
    "clause_tree": f"""WITH l AS {CASE_LINES}, g AS (SELECT *, count(*) FILTER (regexp_matches(text, '{ln.LEADER}')) OVER (PARTITION BY doc_id, page_no) AS leaders, regexp_extract(text, '{ln.ANNEX}', 1) AS x, regexp_extract(text, '{ln.ANNEX_CLAUSE}', ['n', 't']) AS y, regexp_extract(text, '{ln.NUMBERED}', ['n', 't']) AS z FROM l),
 h AS (SELECT doc_id, page_no, line_no, leaders, text, CASE WHEN x <> '' THEN replace(x, '.', '') WHEN y.n <> '' THEN replace(y.n, 'N.A.', 'NA.') WHEN try_cast(split_part(z.n, '.', 1) AS INT) <= 30 THEN z.n END AS number, CASE WHEN x <> '' THEN '' WHEN y.n <> '' THEN trim(y.t) ELSE trim(z.t) END AS title FROM g),
 c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS on_page FROM h WHERE number <> '' AND leaders < 5 AND length(text) BETWEEN 3 AND 150 AND NOT regexp_matches(text, '{ln.NOISE}')
  AND (title = '' OR NOT (regexp_matches(' ' || title || ' ', '{ln.SENTENCE_LIKE}') OR (ends_with(title, '.') AND length(title) > 25)))
  AND (regexp_matches(number, '[.A-Z]') OR (length(title) >= 4 AND NOT ends_with(title, '.') AND NOT regexp_matches(title, '[0-9]') AND length(replace(title, '(', '')) = length(replace(title, ')', ''))
   AND len(string_split(title, ' ')) BETWEEN 1 AND 12 AND lower(split_part(title, ' ', -1)) NOT IN {ln.DANGLING} AND split_part(title, ' ', 1) NOT IN {ln.STARTERS}))),
 f AS (SELECT doc_id, upper(number) AS u, arg_min(number, o) AS number, arg_min(title, o) AS title, min(o) AS o, min(o) // 1000 AS page_no FROM (SELECT *, page_no * 1000 + line_no AS o FROM c WHERE on_page <= 12) GROUP BY 1, 2),
 p AS (SELECT doc_id, pre AS u, min(o) AS o FROM (SELECT doc_id, o, unnest(list_transform(range(1, len(string_split(u, '.'))), lambda i: array_to_string(string_split(u, '.')[1:i], '.'))) AS pre FROM f) GROUP BY 1, 2),
 t AS (SELECT doc_id, coalesce(f.number, u) AS number, f.o IS NULL OR coalesce(p.o < f.o AND (f.page_no > p.o // 1000 + 1 OR f.title = ''), false) AS late, f.title, f.page_no, p.o // 1000 AS made FROM f FULL JOIN p USING (doc_id, u))
 SELECT doc_id, number, CASE WHEN late THEN '' ELSE title END AS title, (CASE WHEN late THEN made ELSE page_no END)::INT AS page_no, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.[0-9]+$', '') END AS parent, length(number) - length(replace(number, '.', '')) + 1 AS level,
 (row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(number, '.'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN printf('0%05d', x::INT) ELSE '1' || x END)) - 1)::INT AS ord FROM t""",
    "reference_targets": f"""WITH r AS (SELECT s_suppkey AS ref_id, 100 * (s_suppkey % 2) AS later, concat(s_nationkey % 5 + 1, '.', s_nationkey + 1) AS p, concat(s_nationkey % 5 + 1, '.', s_nationkey + 1, '.', s_suppkey) AS number FROM supplier), t AS {structure._TREE}
 SELECT ref_id, r.number, coalesce(a.number, b.number) AS target, (coalesce(a.page_no, b.page_no) + later)::INT AS page_no FROM r LEFT JOIN t a ON a.number = p LEFT JOIN t b ON b.number = split_part(p, '.', 1) WHERE coalesce(a.number, b.number) IS NOT NULL""",
    "polyline_measures": """WITH p AS (SELECT l_orderkey AS key, l_linenumber AS ord, min(l_quantity)::DOUBLE AS x, floor(min(l_extendedprice) / 1000) AS y FROM lineitem GROUP BY 1, 2),
 n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM p WINDOW w AS (PARTITION BY key ORDER BY ord)),
 c AS (SELECT *, coalesce(nx, fx) AS cx, coalesce(ny, fy) AS cy FROM n), s AS (SELECT *, sqrt((cx - x) ** 2 + (cy - y) ** 2) AS step FROM c)
 SELECT key, count(*) AS n, round(sum(CASE WHEN nx IS NULL THEN 0 ELSE step END), 4) AS length, round(sum(step), 4) AS perimeter, round(abs(sum(x * cy - cx * y) / 2), 4) AS area FROM s GROUP BY 1 HAVING count(*) >= 2""",
    "caption_anchors": f"""WITH p AS (SELECT l_orderkey AS key, l_linenumber AS ord, min(l_quantity)::DOUBLE AS x, floor(min(l_extendedprice) / 1000) AS y FROM lineitem GROUP BY 1, 2),
 n AS (SELECT *, {KIND} AS kind, row_number() OVER w AS i, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY key ORDER BY ord)),
 c AS (SELECT key, kind, count(*) AS n, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy, avg(x) AS vx, avg(y) AS vy, avg(x) FILTER (i <= 2) AS mx, avg(y) FILTER (i <= 2) AS my,
  arg_max(x, i) AS lx, arg_max(y, i) AS ly FROM n GROUP BY 1, 2)
 SELECT key, round(CASE WHEN kind = 'Distance' AND n >= 2 THEN mx WHEN kind = 'Perimeter' THEN lx WHEN kind = 'Area' AND n >= 3 AND abs(a) > 1e-9 THEN sx / (3 * a) ELSE vx END, 4) AS x,
  round(CASE WHEN kind = 'Distance' AND n >= 2 THEN my WHEN kind = 'Perimeter' THEN ly WHEN kind = 'Area' AND n >= 3 AND abs(a) > 1e-9 THEN sy / (3 * a) ELSE vy END, 4) AS y FROM c""",
    "page_ranges": """WITH d AS (SELECT DISTINCT user_id, day(ts) AS p FROM events), i AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM d),
 r AS (SELECT user_id, min(p) AS a, max(p) AS b FROM i GROUP BY user_id, g) SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY user_id""",
    "latest_version": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1",
    "thread_counts": "SELECT conv_id, count(*) FILTER (turn > 0) AS replies, arg_min(role, turn) AS opened_by, count(DISTINCT role) AS authors FROM conversations GROUP BY 1",
    "exact_duplicates": "SELECT upper(sha256(text)) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "page_links": """SELECT page_id, count(*) AS n_links, count(DISTINCT t) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages) GROUP BY 1""",
    "token_estimates": f"SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length({NORM.format('text')}) > 72 THEN substr({NORM.format('text')}, 1, 70) || '…' ELSE {NORM.format('text')} END AS title FROM documents",
    "names_and_cells": """SELECT page_id, CASE WHEN s = '' THEN 'x' ELSE s END AS slug, substr(regexp_replace(url, '[\\\\/:*?"<>|]', '_', 'g'), 1, 120) AS file,
 CASE WHEN regexp_matches(c, '[",\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS csv, regexp_replace(c, '\\r\\n|[\\t\\r\\n]', ' ', 'g') AS tsv
 FROM (SELECT page_id, url, trim(regexp_replace(url, '[^A-Za-z0-9.-]', '-', 'g'), '-') AS s, html AS c FROM pages)""",
    "catalog_changes": """SELECT path, change FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'changed' END AS change
 FROM (SELECT doc_id AS path, md5(lang || source) AS hash FROM documents) o FULL JOIN (SELECT doc_id + 7 AS path, md5(lang || source) AS hash FROM documents) n ON o.path = n.path) WHERE change IS NOT NULL""",
}

# Both come from the clause tree's SQL.
_TREE = f"({ORACLES['clause_tree']})"
ORACLES["sub_headings"] = f"SELECT doc_id, number, number || ' ' || title AS label, page_no FROM {_TREE} WHERE contains(number, '.') AND title <> '' AND length(title) <= 110 AND NOT regexp_matches(title, '{ln.EXERCISE}')"
ORACLES["kept_outlines"] = f"SELECT doc_id, count(*) AS n_clauses, count(*) AS n FROM {_TREE} GROUP BY 1 HAVING count(*) >= 2"
