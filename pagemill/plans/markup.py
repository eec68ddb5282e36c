"""Queries on colours, credits, cells, scripts, sections and page lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as gr
from ..operators import markup as mu
from ..sources.tables import book_pages, lines, table

CHANNELS = "l_orderkey, l_linenumber, l_partkey * 7 % 256 AS r, l_suppkey * 31 % 256 AS g, l_partkey * 13 % 256 AS b"
PAGED = "(SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, doc_id, text FROM documents)"
SCRIPTS = "text || CASE WHEN length(source) % 2 = 0 OR lang = 'en' THEN repeat('हिन्दीम', 1000) ELSE ' ' END"


def _colours(s, d):
    t = table(s, d, "lineitem").selectExpr(*CHANNELS.split(", "))
    c = t.withColumn("colour", mu.pack_colour(F.col("r"), F.col("g"), F.col("b")))
    return c.select("l_orderkey", "l_linenumber", "colour", mu.nearest_colour(F.col("colour")).alias("nearest"), mu.exact_colour(F.col("colour")).alias("exact"))


def _sections(s, d):
    p = lines(table(s, d, "documents")).selectExpr("doc_id", "line_no div 4 as page_no", "line_no as seq", "if(line_no % 6 = 3, concat('s', line_no), null) as section")
    marks = p.selectExpr("doc_id", "page_no", "0 as ord", "if(seq % 8 = 4, concat('m', page_no), null) as section")
    return mu.sections_in_force(p, marks)


def _outline_titles(s, d):
    headings = table(s, d, "orders").selectExpr("o_custkey as doc_id", "o_orderkey as number", "o_orderpriority as title")
    outline = table(s, d, "lineitem").join(table(s, d, "orders"), F.expr("l_orderkey = o_orderkey")).where("l_returnflag = 'R'").selectExpr("o_custkey as doc_id", "l_orderkey as number", "concat('Line ', l_linenumber) as title", "l_linenumber as ord")
    return mu.outline_titles(headings, outline)


QUERIES = {
    "colours": _colours,
    "credits": lambda s, d: table(s, d, "events").select("event_id", mu.attribution(F.expr("if(event_type = 'click', ' ', event_type)"), F.expr("if(value > 50, ts, null)"), F.expr("if(value > 20, ts, null)")).alias("credit")),
    "measurement_lines": lambda s, d: table(s, d, "lineitem").select(mu.measurement_line([F.col("l_orderkey"), F.expr("if(l_returnflag = 'R', '=Area, \"x\"', l_returnflag)"), F.col("l_linenumber"), F.lit("m²"), F.lit("1:50"), F.lit(None), F.col("l_linestatus")]).alias("line")),
    "merged_cells": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.posexplode(mu.merged_cells(F.expr("array('W', concat('eight ', s_suppkey, ' o'), 'f rod', '12', s_name, ' ')"))).alias("ord", "c")).select("s_suppkey", "ord", "c.text", "c.span"),
    "script_profile": lambda s, d: mu.script_profile(book_pages(table(s, d, "documents").withColumn("text", F.expr(SCRIPTS)))),
    "sections_in_force": _sections,
    "outline_titles": _outline_titles,
    "source_runs": lambda s, d: mu.source_runs(table(s, d, "documents").selectExpr("lang", "doc_id as ord", "source"), "lang"),
    "blank_pages": lambda s, d: mu.insert_blank(book_pages(table(s, d, "documents")), 2).select("book", "page_no", "doc_id", F.length("text").alias("n_chars")),
}

_FAR = " ".join(f"WHEN {n} THEN (r - {c >> 16}) ** 2 + (g - {c >> 8 & 255}) ** 2 + (b - {c & 255}) ** 2" for n, c in enumerate(mu.PALETTE.values()))

ORACLES = {
    "colours": f"""SELECT l_orderkey, l_linenumber, 4278190080 + r * 65536 + g * 256 + b AS colour, [{", ".join(f"'{n}'" for n in mu.PALETTE)}][list_position(far, list_min(far))] AS nearest,
 CASE r * 65536 + g * 256 + b {" ".join(f"WHEN {c} THEN '{n}'" for n, c in mu.PALETTE.items())} ELSE 'Custom' END AS exact FROM (SELECT *, list_transform(range(5), lambda k: CASE k {_FAR} END) AS far FROM (SELECT {CHANNELS} FROM lineitem))""",
    "credits": "SELECT event_id, concat_ws(' · ', nullif(trim(CASE WHEN event_type = 'click' THEN ' ' ELSE event_type END), ''), CASE WHEN value > 20 THEN strftime(ts, '%Y-%m-%d') END) AS credit FROM events",
    "measurement_lines": """SELECT l_orderkey || ',' || CASE WHEN l_returnflag = 'R' THEN concat('"''=Area, ', '""x""', '"') ELSE l_returnflag END || ',' || l_linenumber || ',m²,1:50,,' || l_linestatus AS line FROM lineitem""",
    "merged_cells": """WITH c AS (SELECT s_suppkey, trim(unnest(['W', concat('eight ', s_suppkey, ' o'), 'f rod', '12', s_name, ' '])) AS c, unnest(range(6)) AS i FROM supplier),
 g AS (SELECT *, sum((NOT coalesce((regexp_matches(p, '\\p{L}$') AND regexp_matches(c, '^\\p{Ll}')) OR (ends_with(p, '/') AND c <> ''), false))::INT) OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS g FROM (SELECT *, lag(c) OVER (PARTITION BY s_suppkey ORDER BY i) AS p FROM c))
 SELECT s_suppkey, g::INT AS ord, string_agg(c, '' ORDER BY i) AS text, count(*)::INT AS span FROM g GROUP BY s_suppkey, g""",
    "script_profile": f"""WITH p AS (SELECT source AS book, {SCRIPTS} AS text FROM documents), l AS (SELECT book, sum(len(regexp_extract_all(text, '\\p{{L}}')))::BIGINT AS letters FROM p GROUP BY 1),
 o AS (SELECT book, unicode(c) // 128 AS block, count(*) AS n FROM (SELECT book, unnest(regexp_extract_all(text, '[^{gr.UNMAPPED}{gr.EXPECTED}]')) AS c FROM p) WHERE regexp_matches(c, '^\\p{{L}}$') GROUP BY 1, 2) SELECT book, block, n, letters FROM o JOIN l USING (book) WHERE n >= letters * 0.2""",
    "sections_in_force": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), r AS (SELECT doc_id, seq // 4 AS page_no, seq, 0 AS m, CASE WHEN seq % 6 = 3 THEN concat('s', seq) END AS section FROM l
 UNION ALL SELECT doc_id, seq // 4, -1, 1, concat('m', seq // 4) FROM l WHERE seq % 8 = 4) SELECT doc_id, page_no, seq, section FROM (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, seq ROWS UNBOUNDED PRECEDING), 'Front matter') AS section FROM (SELECT doc_id, page_no, seq, m, section AS x FROM r)) WHERE m = 0""",
    "outline_titles": """SELECT o_custkey AS doc_id, o_orderkey AS number, coalesce('Line ' || k, o_orderpriority) AS title FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
    "source_runs": """WITH g AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS i FROM documents),
 r AS (SELECT lang, source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY lang, source, i) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY first) AS run, source, first, last, n FROM r""",
    "blank_pages": f"SELECT book, page_no + (page_no > 2)::INT AS page_no, doc_id, length(text) AS n_chars FROM {PAGED} UNION ALL SELECT book, 3, NULL, 0 FROM {PAGED} WHERE page_no = 2",
}
