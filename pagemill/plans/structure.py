"""Queries on lines, grades, chunks, page lists, tables and dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as gr
from ..functions import lines as ln
from ..functions.text import has_leader, normalise
from ..operators import analysis as an
from ..operators import chunks as ch
from ..operators import flow as fl
from ..operators import pageops as po
from ..operators import phrases as ph
from ..operators import places as pl
from ..sources.tables import book_pages, lines, table, to_jsonl
from .fixtures import CLAUSE_LINES, NORM, clause_lines

#: Documents with defects, so that every grade occurs.
DEFECTS = "text || CASE doc_id % 7 WHEN 0 THEN ' �' WHEN 1 THEN ' ∑ x' WHEN 2 THEN ' हिन्दी' WHEN 3 THEN ' yesss' WHEN 4 THEN ' 1 2 3 4 5 6 7 8 9 10 11 12.5' ELSE '' END"
#: RE2 has no back-references: three of each Latin letter in turn.
TRIPLES = "|".join(chr(c) * 3 for c in range(0x41, 0x250) if chr(c).isalpha())
PAGED = "SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, doc_id FROM documents"


def _profile(s, d):
    line = lines(table(s, d, "documents")).select("doc_id", normalise(F.col("text")).alias("t"))
    t = F.col("t")
    kinds = {"blank": t == "", "leaders": has_leader(t), "entries": ln.is_entry(t), "page_numbers": ln.is_page_number(t), "captions": ln.is_caption(t), "blocks": ln.is_block_start(t), "headings": ln.is_heading(t), "prose": ln.is_prose(t), "sentences": ln.is_sentence_like(t)}
    return line.groupBy("doc_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def _grades(s, d):
    t = table(s, d, "documents").where("text is not null").selectExpr("doc_id", f"{DEFECTS} as text")
    return t.withColumn("issues", gr.issues(F.col("text"))).select("doc_id", gr.grade(F.col("issues"), F.col("text")).alias("quality"), F.array_join("issues", ",").alias("issues"))


def _grades_by_label(s, d):
    return _grades(s, d).join(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").groupBy("quality", "label").agg(F.count(F.lit(1)).alias("n"))


def _line_pages(s, d):
    """Every line a page, so that repeated lines and contents pages occur."""
    return lines(table(s, d, "documents")).selectExpr("doc_id", "line_no as page_no", "text", "concat('Book ', doc_id) as title")


def _chunks(s, d):
    out = ch.document_chunks(_line_pages(s, d), ch.ChunkOptions(target=200))
    return out.select("id", "doc_id", "chunk_index", "text", "section_title", "context_before", "token_estimate", "quality")


def _flow_parts(s, d):
    """Every line a page with one paragraph, and headings that it prints or not."""
    line = _line_pages(s, d).select("doc_id", "page_no", F.lit(0).alias("seq"), normalise(F.col("text")).alias("text")).where("text <> ''")
    kinds = ((0, "page_no % 7 = 3", "concat('zz ', page_no)"), (1, "page_no % 5 = 2", "left(text, 12)"), (2, "page_no % 10 = 2", "left(text, 5)"))
    titles = [line.where(when).selectExpr("doc_id", "page_no", f"{k} AS ord", f"{title} AS title") for k, when, title in kinds]
    return line.withColumn("units", F.array("text")), fl.section_markers(titles[0].union(titles[1]).union(titles[2]))


def _section_flow(s, d):
    paragraphs, markers = _flow_parts(s, d)
    return fl.flow(paragraphs, markers).select("doc_id", "page_no", "section", "heading", "starts")


def _packed_units(s, d):
    """Chunk numbers of the lines' lengths."""
    paragraphs, markers = _flow_parts(s, d)
    own = fl.packed(paragraphs, fl.flow(paragraphs, markers, limit=800, floor=200), 0)
    return own.select("doc_id", "chunk_index", F.col("page_start"), F.col("page_end"), F.length("body").alias("size"))


def _chunk_lines(s, d):
    docs = table(s, d, "documents")
    files = docs.selectExpr("doc_id", "concat('/in/', source, '-', doc_id, '.txt') as path", "concat('Book ', doc_id) as title")
    labels = _line_pages(s, d).where("page_no % 2 = 1").selectExpr("doc_id", "page_no", "concat('A-', page_no) as label")
    equations = _line_pages(s, d).where("page_no % 3 = 0").selectExpr("doc_id", "page_no", "substr(text, 1, 9) as label")
    return to_jsonl(ch.export(ch.document_chunks(_line_pages(s, d)), files, labels, equations))


def _reference_pages(s, d):
    found = table(s, d, "supplier").selectExpr("0 as doc_id", "s_suppkey as ref_id", "concat('see ', s_nationkey % 5 + 1, '.', s_nationkey + 1, '.', s_suppkey, ', Table ', s_suppkey, '.1') as text")
    refs = found.select("doc_id", "ref_id", F.explode(po.cited_numbers(F.col("text"))).alias("number"))
    return an.resolve_references(refs, an.clauses(clause_lines(s, d)))


def glyph_rows(s, d):
    # Some line numbers occur twice in an order.
    one = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("text"))
    return one.selectExpr("l_orderkey as key", "l_linenumber as ord", "cast(s % 40 as double) as x0", "s % 40 + 3.0D as x1", "cast(q as double) as y", "text")


def points_and_segments(s, d):
    e = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    points = e.selectExpr("l_orderkey as key", "l_linenumber as pid", "cast(p % 100 as double) as x", "cast(q + 2 as double) as y")
    return points, e.selectExpr("l_orderkey as key", "l_linenumber as sid", "cast(s as double) as x0", "cast(q as double) as y0", "cast(p % 100 as double) as x1", "cast(q + 10 as double) as y1")


def _snapped(s, d):
    got = pl.snap(*points_and_segments(s, d), 6.0)
    return got.select("key", "pid", "kind", F.round("distance", 4).alias("distance"))


def boxes(s, d):
    points, segments = points_and_segments(s, d)
    return points.selectExpr("key", "pid", "x as x0", "y as y0", "x + 9 as x1", "y + 9 as y1"), segments.selectExpr("key", "least(x0, x1) as x0", "y0", "greatest(x0, x1) as x1", "y1")


def _stamped(s, d):
    """Pages with a stamp on nine of ten."""
    return book_pages(table(s, d, "documents")).withColumn("text", F.expr("if(page_no % 10 = 9, text, 'Stamped  copy ' || book || '\n' || text)"))


QUERIES = {
    "phrase_options": lambda s, d: ph.find_phrases(table(s, d, "documents"), "of the", whole_word=True),
    "phrase_totals": lambda s, d: ph.phrase_totals(table(s, d, "documents"), "the"),
    "snap_points": _snapped,
    "free_boxes": lambda s, d: pl.without_overlap(*boxes(s, d), "key").select("key", "pid"),
    "watermarks": lambda s, d: pl.watermarks(_stamped(s, d)),
    "stripped_pages": lambda s, d: pl.strip_lines(_stamped(s, d), pl.watermarks(_stamped(s, d))),
    "running_titles": lambda s, d: pl.running_titles(_stamped(s, d)),
    "lengths_in_units": lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 500 as double) as pt", "concat('1:', o_custkey % 50) as t", "element_at(array('mm', 'cm', 'm', 'km', 'in', 'ft', 'pt'), cast(o_orderkey % 7 + 1 as int)) as unit").select("o_orderkey", pl.in_unit(F.col("pt"), pl.scale_of(F.col("t")), F.col("unit")).alias("length")).where("not isnan(length)").withColumn("length", F.floor(F.col("length") * 1e6 + 0.5) / 1e6),
    "html_texts": lambda s, d: pl.to_html(lines(table(s, d, "documents")).selectExpr("doc_id", "0 as page_no", "line_no as ord", "line_no % 7 as depth", "text")),
    "grid_csv": lambda s, d: pl.grid_text(po.table_grid(glyph_rows(s, d), 1.0)),
    "page_profile": _profile,
    "quality_grades": _grades,
    "quality_by_label": _grades_by_label,
    "chunks": _chunks,
    "chunk_lines": _chunk_lines,
    "section_flow": _section_flow,
    "packed_units": _packed_units,
    "reference_pages": _reference_pages,
    "clause_as_of": lambda s, d: po.clause_as_of(s.range(0, 26).selectExpr("0 as doc_id", "cast(id as int) as page_no"), an.clauses(clause_lines(s, d))),
    "chapter_ranges": lambda s, d: po.chapter_ranges(an.clauses(clause_lines(s, d)), 30),
    "merge_offsets": lambda s, d: po.merge_offsets(table(s, d, "orders").selectExpr("o_custkey as set_id", "o_orderkey as ord", "o_orderkey % 7 + 1 as n_pages"), "set_id"),
    "page_edit": lambda s, d: po.delete_pages(book_pages(table(s, d, "documents")), F.col("page_no") % 5 == 0).select("book", "page_no", "doc_id", po.rotate(F.col("doc_id") % 4, F.lit(3)).alias("rotation")),
    "page_sets": lambda s, d: table(s, d, "nation").selectExpr("n_nationkey", "concat(n_nationkey + 1, ', ', n_regionkey + 9, '-', n_regionkey + 6, if(n_nationkey % 4 = 0, '; x', '')) as t").select("n_nationkey", F.array_join(po.page_set(F.col("t"), F.lit(22)), ",").alias("pages")),
    "table_grid": lambda s, d: po.table_grid(glyph_rows(s, d), 1.0),
    "page_dates": lambda s, d: table(s, d, "events").select("event_id", po.parse_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+01'30'"))).alias("utc")),
    "replies": lambda s, d: po.decode_replies(po.encode_replies(table(s, d, "conversations").selectExpr("conv_id", "turn", "role as author", "text"), "conv_id", "turn"), "conv_id"),
}

_GRADED = f"""SELECT doc_id, text, regexp_matches(text, '[{gr.UNMAPPED}]') AS a, regexp_matches(text, '[^{gr.UNMAPPED}{gr.EXPECTED}]') AS b,
 EXISTS (SELECT 1 FROM unnest(string_split_regex(text, '[ \\t\\n]+')) AS u(t) WHERE regexp_matches(t, '^[\\p{{L}}0-9,]+$') AND regexp_matches(t, '{TRIPLES}') AND NOT regexp_matches(t, '{gr.ROMAN_OR_WEB}')) AS c, regexp_matches(text, '{gr.TABLE}') AS d
 FROM (SELECT doc_id, {DEFECTS} AS text FROM documents WHERE text IS NOT NULL)"""
_GRADES = f"""SELECT doc_id, CASE WHEN a OR b OR c THEN 'suspect' WHEN d OR regexp_matches(text, '{gr.MATHS}') THEN 'check' ELSE 'ok' END AS quality,
 concat_ws(',', CASE WHEN a THEN 'unmapped' END, CASE WHEN b THEN 'unexpected' END, CASE WHEN c THEN 'duplicated' END, CASE WHEN d THEN 'table' END) AS issues FROM ({_GRADED})"""
_CLAUSES = f"(SELECT number, page_no FROM (SELECT regexp_extract(text, '^([0-9.]+) ', 1) AS number, page_no FROM {CLAUSE_LINES}))"
_TREE = f"(SELECT * FROM {_CLAUSES} UNION ALL SELECT split_part(number, '.', 1), min(page_no) FROM {_CLAUSES} WHERE split_part(number, '.', 1) NOT IN (SELECT number FROM {_CLAUSES}) GROUP BY 1)"
_E = "(SELECT l_orderkey AS key, l_linenumber AS n, min(l_suppkey)::DOUBLE AS s, min(l_quantity)::DOUBLE AS q, (min(l_partkey) % 100)::DOUBLE AS p FROM lineitem GROUP BY 1, 2)"
_PAIRS = f"(SELECT a.key, a.n AS pid, a.p AS x, a.q + 2 AS y, b.s AS x0, b.q AS y0, b.p AS x1, b.q + 10 AS y1, b.p - b.s AS dx FROM {_E} a JOIN {_E} b USING (key))"
CROSSINGS = f"""(SELECT key, sid, sid2, ax + t * rx AS x, ay + t * 10.0 AS y FROM (SELECT *, ((bx - ax) * 10.0 - (b_y - ay) * sx) / c AS t, ((bx - ax) * 10.0 - (b_y - ay) * rx) / c AS u FROM
 (SELECT a.key, a.n AS sid, b.n AS sid2, a.s AS ax, a.q AS ay, b.s AS bx, b.q AS b_y, a.p - a.s AS rx, b.p - b.s AS sx, (a.p - a.s) * 10.0 - 10.0 * (b.p - b.s) AS c FROM {_E} a JOIN {_E} b ON a.key = b.key AND a.n < b.n) WHERE abs(c) >= 1e-9) WHERE t BETWEEN -1e-6 AND 1 + 1e-6 AND u BETWEEN -1e-6 AND 1 + 1e-6)"""
_STAMPED = "(SELECT book, page_no, CASE WHEN page_no % 10 = 9 THEN text ELSE 'Stamped  copy ' || book || chr(10) || text END AS text FROM (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, text FROM documents))"


def _count(test: str) -> str:
    return f"count(*) FILTER ({test})"


ORACLES = {
    "phrase_options": r"""WITH m AS (SELECT doc_id, text, string_split_regex(text, '(?i)of\s+the') AS p, regexp_extract_all(text, '(?i)of\s+the') AS h FROM documents WHERE regexp_matches(text, '(?i)of\s+the')),
 e AS (SELECT doc_id, text, h[i] AS hit, list_sum(list_transform(p[:i], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0)::INT AS pos, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m)),
 w AS (SELECT *, length(hit)::INT AS length, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM e WHERE NOT regexp_matches(substr(text, pos, (pos > 0)::INT), '[\pL\pN]') AND NOT regexp_matches(substr(text, pos + length(hit) + 1, 1), '[\pL\pN]'))
 SELECT doc_id, ord::INT AS ord, pos AS char_start, length, (CASE WHEN pos > 44 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(pos - 44, 0) + 1, pos + length + 44 - greatest(pos - 44, 0)), '\s+', ' ', 'g'))
  || (CASE WHEN pos + length + 44 < length(text) THEN '…' ELSE '' END) AS snippet FROM w""",
    "phrase_totals": "SELECT count(*) AS files, count(*) FILTER (n > 0) AS files_with_hits, sum(n)::BIGINT AS hits FROM (SELECT len(regexp_extract_all(text, '(?i:the)')) AS n FROM documents)",
    "snap_points": f"""WITH t AS (SELECT *, greatest(0, least(1, ((x - x0) * dx + (y - y0) * 10) / (dx * dx + 100))) AS t FROM {_PAIRS}),
 c AS (SELECT key, pid, 0 AS kind, sqrt((x0 - x) ** 2 + (y0 - y) ** 2) AS d FROM t UNION ALL SELECT key, pid, 0, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) FROM t
 UNION ALL SELECT p.key, p.n, 1, sqrt((c.x - p.p) ** 2 + (c.y - p.q - 2) ** 2) FROM {_E} p JOIN {CROSSINGS} c USING (key)
 UNION ALL SELECT key, pid, 2, sqrt((x0 + dx / 2 - x) ** 2 + (y0 + 5 - y) ** 2) FROM t UNION ALL SELECT key, pid, 3, sqrt((x0 + t * dx - x) ** 2 + (y0 + t * 10 - y) ** 2) FROM t),
 k AS (SELECT * FROM c WHERE d <= 6) SELECT key, pid, kind, round(min(d), 4) AS distance FROM k JOIN (SELECT key, pid, min(kind) AS kind FROM k GROUP BY 1, 2) USING (key, pid, kind) GROUP BY 1, 2, 3""",
    "free_boxes": f"SELECT a.key, a.n AS pid FROM {_E} a WHERE NOT EXISTS (SELECT 1 FROM {_PAIRS} b WHERE b.key = a.key AND b.pid = a.n AND x < greatest(x0, x1) AND least(x0, x1) < x + 9 AND y < y1 AND y0 < y + 9)",
    "watermarks": f"""WITH p AS {_STAMPED}, c AS (SELECT book, line, count(DISTINCT page_no) AS on_pages FROM (SELECT book, page_no, {NORM.format("l")} AS line FROM (SELECT book, page_no, unnest(string_split(text, chr(10))) AS l FROM p)) WHERE length(line) >= 4 GROUP BY 1, 2)
 SELECT book, line, on_pages, line AS label FROM c JOIN (SELECT book, count(*) AS n FROM p GROUP BY 1) USING (book) WHERE on_pages >= greatest(3, ceil(n * 0.8))""",
    "stripped_pages": f"SELECT book, page_no, CASE WHEN page_no % 10 = 9 THEN text ELSE substr(text, length('Stamped  copy ' || book) + 2) END AS text FROM {_STAMPED}",
    "running_titles": f"SELECT book, 'Stamped copy ' || book AS title, count(*) FILTER (page_no % 10 <> 9) AS on_pages FROM {_STAMPED} GROUP BY book",
    "lengths_in_units": "SELECT o_orderkey, floor((o_orderkey % 500)::DOUBLE * (25.4::DOUBLE / 72) * (o_custkey % 50)::DOUBLE / [1.0, 10.0, 1000.0, 1000000.0, 25.4, 304.8, 25.4::DOUBLE / 72][o_orderkey % 7 + 1]::DOUBLE * 1e6 + 0.5) / 1e6 AS length FROM orders WHERE o_custkey % 50 > 0",
    "html_texts": """SELECT doc_id, string_agg('<' || g || '>' || replace(replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || g || '>', chr(10) ORDER BY k) AS html
 FROM (SELECT doc_id, l, k, CASE WHEN k % 7 = 0 THEN 'p' ELSE 'h' || least(greatest(k % 7 + 1, 2), 6) END AS g FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)) GROUP BY 1""",
    "page_profile": f"""SELECT doc_id, {_count("t = ''")} AS blank, {_count(f"regexp_matches(t, '{ln.LEADER}')")} AS leaders, {_count(f"regexp_matches(t, '{ln.ENTRY}')")} AS entries, {_count(f"regexp_matches(t, '{ln.PAGE_NUMBER}')")} AS page_numbers,
 {_count(f"regexp_matches(t, '{ln.CAPTION}')")} AS captions, {_count(f"regexp_matches(t, '{ln.BLOCK}')")} AS blocks, {_count(f"regexp_matches(t, '{ln.HEADING}') AND length(t) < 70 AND NOT ends_with(t, '.')")} AS headings,
 {_count(f"len(regexp_extract_all(t, '{ln.PROSE_WORD}')) >= 2")} AS prose, {_count(f"regexp_matches(' ' || t || ' ', '{ln.SENTENCE_LIKE}') OR (ends_with(t, '.') AND length(t) > 25)")} AS sentences
 FROM (SELECT doc_id, {NORM.format("l")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1""",
    "quality_grades": _GRADES,
    "quality_by_label": f"SELECT g.quality, l.quality AS label, count(*) AS n FROM ({_GRADES}) g JOIN labels l USING (doc_id) GROUP BY 1, 2",
    "reference_pages": f"""WITH r AS (SELECT s_suppkey AS ref_id, concat(s_nationkey % 5 + 1, '.', s_nationkey + 1) AS p, concat(s_nationkey % 5 + 1, '.', s_nationkey + 1, '.', s_suppkey) AS n FROM supplier), t AS {_TREE}
 SELECT ref_id, regexp_extract(n, '^[0-9]+\\.[0-9]+\\.[0-9]{{1,3}}') AS number, coalesce(a.number, b.number) AS target, coalesce(a.page_no, b.page_no) AS page_no FROM r LEFT JOIN t a ON a.number = p LEFT JOIN t b ON b.number = split_part(p, '.', 1) WHERE coalesce(a.number, b.number) IS NOT NULL""",
    "clause_as_of": f"SELECT 0 AS doc_id, p.i::INT AS page_no, (SELECT arg_max(number, page_no * 10000 + length(number) * 100 + coalesce(try_cast(split_part(number, '.', 2) AS INT), 0)) FROM {_TREE} t WHERE t.page_no <= p.i) AS clause FROM range(26) p(i)",
    "chapter_ranges": f"SELECT 0 AS doc_id, c.number, c.page_no AS first_page, coalesce((SELECT min(o.page_no) FROM {_TREE} o WHERE o.page_no > c.page_no AND NOT starts_with(o.number, c.number || '.')) - 1, 30) AS last_page FROM {_TREE} c",
    "merge_offsets": "SELECT o_custkey AS set_id, o_orderkey AS ord, o_orderkey % 7 + 1 AS n_pages, (coalesce(sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_page FROM orders",
    "page_edit": f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY page_no) - 1 AS page_no, doc_id, (doc_id % 4 + 3) % 4 AS rotation FROM ({PAGED}) WHERE page_no % 5 <> 0",
    "page_sets": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey < 22 THEN (SELECT string_agg(p::VARCHAR, ',' ORDER BY p) FROM (SELECT n_nationkey + 1 AS p UNION SELECT unnest(range(n_regionkey + 6, n_regionkey + 10)))) END AS pages FROM nation",
    "table_grid": """WITH g AS (SELECT l_orderkey AS key, l_linenumber AS ord, min(l_suppkey) % 40 AS x0, min(l_suppkey) % 40 + 3 AS x1, min(l_quantity)::DOUBLE AS y, min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2),
 a AS (SELECT *, coalesce((lag(y) OVER (PARTITION BY key ORDER BY y DESC, ord) - y > 0.7)::INT, 0) AS r, coalesce((x0 - max(x1) OVER (PARTITION BY key ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3.5)::INT, 0) AS c FROM g),
 b AS (SELECT *, sum(r) OVER (PARTITION BY key ORDER BY y DESC, ord)::BIGINT AS row, sum(c) OVER (PARTITION BY key ORDER BY x0, ord)::BIGINT AS col FROM a) SELECT key, row, col, string_agg(text, ' ' ORDER BY ord) AS text FROM b GROUP BY 1, 2, 3""",
    "page_dates": "SELECT event_id, date_trunc('second', ts)::TIMESTAMP - INTERVAL 90 MINUTE AS utc FROM events",
    "replies": "SELECT conv_id, turn AS id, text, role AS author FROM conversations WHERE trim(text) <> ''",
}

ORACLES["grid_csv"] = f"""WITH t AS ({ORACLES['table_grid']}), r AS (SELECT key, row, max(max(col)) OVER (PARTITION BY key) AS w FROM t GROUP BY 1, 2), c AS (SELECT key, row, unnest(range(w + 1)) AS col FROM r),
 l AS (SELECT key, row, string_agg(coalesce(text, ''), ',' ORDER BY col) AS line FROM c LEFT JOIN t USING (key, row, col) GROUP BY 1, 2) SELECT key, string_agg(line, chr(13) || chr(10) ORDER BY row) || chr(13) || chr(10) AS content FROM l GROUP BY 1"""

_BARE = lambda x: f"CASE WHEN regexp_matches({x}, '\\p{{L}}[^0-9]*\\s[0-9]{{1,4}}$') THEN regexp_replace({x}, '\\s+[0-9]{{1,4}}$', '') ELSE {x} END"
_SECTIONS = f"""l AS (SELECT doc_id, i AS page_no, {NORM.format("t")} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
 h AS (SELECT doc_id, page_no, t, regexp_extract(t, '{ln.BODY_HEADING}', 1) AS n FROM l WHERE t <> ''),
 q AS (SELECT *, CASE WHEN length(t) <= 120 AND NOT ends_with(t, '.') AND NOT regexp_matches(ltrim(substr(t, CASE WHEN n = '' THEN 1 ELSE length(n) + 2 END), '. '), '[.!?;:]\\s') THEN {_BARE("t")} END AS printed,
  CASE WHEN page_no % 7 = 3 THEN 'zz ' || page_no END AS a, CASE WHEN page_no % 5 = 2 THEN trim(substr(t, 1, 12)) END AS b, CASE WHEN page_no % 10 = 2 THEN trim(substr(t, 1, 5)) END AS c FROM h),
 r AS (SELECT *, CASE WHEN b IS NOT NULL THEN coalesce(printed, {_BARE("b")}) WHEN a IS NOT NULL THEN {_BARE("a")} END AS own FROM q),
 f AS (SELECT doc_id, page_no, t, coalesce(own, last_value(CASE WHEN c IS NOT NULL THEN {_BARE("c")} ELSE own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Front matter') AS section,
  b IS NOT NULL AND printed IS NOT NULL AS heading, own IS NOT NULL AS starts FROM r)"""
ORACLES["section_flow"] = f"WITH {_SECTIONS} SELECT doc_id, page_no::INT AS page_no, section, heading, starts FROM f"
ORACLES["packed_units"] = f"""WITH RECURSIVE {_SECTIONS},
 u AS (SELECT doc_id, page_no, length(t) AS n, starts, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM f),
 z AS (SELECT doc_id, k, page_no, n, 0 AS chunk, n + 1 AS raw FROM u WHERE k = 1
  UNION ALL SELECT u.doc_id, u.k, u.page_no, u.n, z.chunk + x.cut, CASE WHEN x.cut = 1 THEN 0 ELSE z.raw END + u.n + 1
  FROM z JOIN u ON u.doc_id = z.doc_id AND u.k = z.k + 1, LATERAL (SELECT CASE WHEN u.starts AND z.raw >= 200 THEN (z.raw - 1 >= 200)::INT ELSE (z.raw + u.n + 1 > 800)::INT END AS cut) x)
 SELECT doc_id, chunk AS chunk_index, min(page_no)::INT AS page_start, max(page_no)::INT AS page_end, (sum(n + 1) - 1)::INT AS size FROM z GROUP BY 1, 2"""
