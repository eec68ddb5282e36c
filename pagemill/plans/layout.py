"""Queries on places, names, references, glyphs and outlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..functions import names as na
from ..functions.wrapping import wrapped
from ..operators import analysis as an
from ..operators import glyphs as gl
from ..operators import layout as la
from ..operators import places as pl
from ..operators import references as re
from ..sources.tables import book_pages, table
from . import structure as st
from .fixtures import NORM, clause_lines

TURNED = "l_orderkey, l_linenumber, l_quantity * 12 AS x, l_quantity * 15 AS y, l_linenumber % 4 AS r"
TITLES = "doc_id, CASE doc_id % 4 WHEN 0 THEN 'Microsoft Word - ' || source || '.docx' WHEN 1 THEN 'document' || doc_id WHEN 2 THEN NULL ELSE source || ' ‑  guide.' END AS stated, CASE WHEN doc_id % 3 = 0 THEN lang || '. ' END AS running, '/books/' || source || '.pdf' AS path"
FORMULAS = "o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a = b + c' WHEN 1 THEN 'x = ( ) + y' WHEN 2 THEN 'k Rd,c f k Rd,c v s' WHEN 3 THEN 'a b c d e f g h i j k' ELSE o_orderpriority END AS t, o_orderkey % 7 = 0 AS stacked"
TABLED = f"doc_id, 'Table ' || (doc_id % 9) || '.2 ' || {st.DEFECTS} AS text"
REFERRED = ["0 AS doc_id", "s_suppkey + 1000 AS page_no", "concat('see ', s_nationkey % 5 + 1, '.', s_nationkey + 1, '.', s_suppkey % 100, ', Annex ', chr(65 + s_suppkey % 7), ' and Table ', s_suppkey % 7, '.1') AS text"]
NAMED = [("concat('Annex ', chr(65 + r_regionkey))", 200, 0), ("concat(chr(65 + r_regionkey), '.', r_regionkey + 1, ' Rules')", 200, 1), ("concat('Table ', r_regionkey, '.1 — ', r_name)", 300, 0)]


def _lines(s, d):
    r = table(s, d, "region")
    parts = [r.selectExpr("0 as doc_id", f"r_regionkey + {at} as page_no", f"{n} as line_no", f"{text} as text") for text, at, n in NAMED]
    return parts[0].union(parts[1]).union(parts[2])


def _cross_references(s, d):
    pages = table(s, d, "supplier").selectExpr(*REFERRED)
    targets = re.page_map(an.clauses(clause_lines(s, d)), re.annex_headings(_lines(s, d)), re.captions(_lines(s, d)))
    return re.cross_references(pages, targets).select("page_no", "label", "target")


def _headings(s, d):
    found = re.annex_headings(_lines(s, d)).select(F.col("number").alias("name"), "title", "page_no")
    return found.unionByName(re.captions(_lines(s, d)).select(F.col("key").alias("name"), F.lit("").alias("title"), "page_no"))


def _drawn(s, d):
    """Names of suppliers as glyphs; every other one is drawn twice."""
    one = table(s, d, "supplier").select("s_nationkey", "s_suppkey", F.posexplode(F.split("s_name", "")).alias("k", "c")).where("c <> ''")
    two = one.withColumn("again", F.expr("explode(if(s_suppkey % 2 = 1, array(0, 1), array(0)))"))
    return two.selectExpr("s_nationkey as doc_id", "s_suppkey as page_no", "2 * k + again as idx", "ascii(c) as unit", "10.0D * k as x0", "0.0D as y0", "10.0D * k + 8 as x1", "10.0D as y1")


def _turned(s, d):
    size = [F.lit(612.0), F.lit(792.0), F.col("r"), F.lit(1.5), F.lit(10.0), F.lit(20.0)]
    t = table(s, d, "lineitem").selectExpr(*TURNED.split(", ")).withColumn("p", ge.to_device(F.col("x"), F.col("y"), *size)).withColumn("q", ge.to_page(F.col("p.x"), F.col("p.y"), *size))
    return t.select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), ((F.abs(F.col("q.x") - F.col("x")) < 1e-6) & (F.abs(F.col("q.y") - F.col("y")) < 1e-6)).alias("returns"))


def _constrained(s, d):
    p = ge.constrained(F.col("l_quantity") - 25, (F.col("l_suppkey") % 50 - 25).cast("double"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", (F.round("p.x", 4) + 0.0).alias("dx"), (F.round("p.y", 4) + 0.0).alias("dy"))


def _outline(s, d):
    nodes = table(s, d, "nation").selectExpr("0 as doc_id", "n_nationkey as node", "if(n_nationkey > 1, array(0, n_nationkey div 2), array()) as path", "n_name as title", "n_nationkey as page_no")
    kept = table(s, d, "supplier").selectExpr("0 as doc_id", "s_nationkey as page_no", "s_nationkey + 100 as new_page").distinct()
    return la.retarget(nodes.withColumn("path", F.col("path").cast("array<int>")), kept)


def _revised(s, d):
    old = book_pages(table(s, d, "documents"))
    return la.page_diff(old, old.withColumn("text", F.expr("if(page_no % 5 = 0, text || '!', text)")).withColumn("page_no", F.expr("if(page_no = 0, -1, page_no)")))


def _scales(s, d):
    pages = table(s, d, "orders").selectExpr("o_custkey as doc_id", "o_orderkey as page_no")
    own = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as doc_id", "o_orderkey as page_no", "o_totalprice as scale")
    return la.effective_scale(pages, own, table(s, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as doc_id", "c_acctbal as scale"))


def _glyph_boxes(s, d):
    return st.glyph_rows(s, d).withColumn("row", F.lit(0))


QUERIES = {
    "turned_places": _turned,
    "constrained_steps": _constrained,
    "crossings": lambda s, d: pl.crossings(st.points_and_segments(s, d)[1], 48.0).select("key", "sid", "sid2", "x", "y"),
    "named_sizes": lambda s, d: table(s, d, "part").select("p_partkey", ge.named_size(F.concat(F.lit("a"), F.col("p_size") % 6), F.col("p_size") % 2 == 0).alias("z")).select("p_partkey", F.round("z.width", 3).alias("width"), F.round("z.height", 3).alias("height")),
    "measured_values": lambda s, d: table(s, d, "part").select("p_partkey", ge.measured(F.col("p_size") * ge.units_a_point(F.lit(1.0), F.col("p_partkey") % 100, F.lit(10.0)), F.lit("cm"), 1, True).alias("area")),
    "document_titles": lambda s, d: table(s, d, "documents").selectExpr(*_split(TITLES)).select("doc_id", na.document_title(F.col("stated"), F.col("running"), F.col("path")).alias("title")),
    "citations": lambda s, d: table(s, d, "nation").selectExpr("n_nationkey", "if(n_nationkey % 3 = 0, chr(65 + n_nationkey), concat('6.', n_nationkey)) as number", "if(n_regionkey = 0, ' ', n_name) as title", "cast(n_regionkey as string) as page").select(
        "n_nationkey", na.clause_display(F.col("number"), F.col("title")).alias("shown"), na.cite_clause(F.lit("Code"), F.col("number"), F.col("title"), F.col("page")).alias("clause"), na.cite_passage(F.lit("Code"), F.col("number"), F.col("page"), F.col("title")).alias("passage")
    ),
    "scramble_reasons": lambda s, d: table(s, d, "orders").selectExpr(*_split(FORMULAS)).select("o_orderkey", na.scramble_reason(F.col("t"), F.col("stacked")).alias("reason")),
    "flattened_tables": lambda s, d: table(s, d, "documents").selectExpr(*_split(TABLED)).select("doc_id", na.flattened_table(F.col("text")).alias("table_name")),
    "occurrence_ids": lambda s, d: table(s, d, "documents").select("doc_id", na.occurrence_id("lang", "source", "doc_id").alias("id")),
    "cross_references": _cross_references,
    "annexes_and_captions": _headings,
    "repaired_glyphs": lambda s, d: gl.repaired_lines(_drawn(s, d)),
    "wrapped_texts": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(wrapped(300.0)("text"), "\n").alias("lines")),
    "revised_pages": _revised,
    "nearest_boxes": lambda s, d: la.nearest_boxes(st.points_and_segments(s, d)[0], st.boxes(s, d)[0].withColumnRenamed("pid", "ord")),
    "recent_paths": lambda s, d: la.recent(table(s, d, "events"), "user_id", "event_type", "ts"),
    "bookmark_targets": _outline,
    "visiting_order": lambda s, d: la.visiting_order(book_pages(table(s, d, "documents")), F.lit(2)).select("book", "page_no", "visit"),
    "running_totals": lambda s, d: la.running_totals(table(s, d, "orders").selectExpr("o_custkey as folder", "o_orderkey as file", "o_orderkey % 3 as hits"), "folder", ["file"]),
    "distinct_coordinates": lambda s, d: la.distinct_coordinates(st.glyph_rows(s, d), "key", "y"),
    "text_runs": lambda s, d: la.text_runs(_glyph_boxes(s, d), 4.0),
    "text_columns": lambda s, d: la.text_column(st.glyph_rows(s, d).withColumn("x1", F.col("x1") + F.col("y"))),
    "effective_scales": _scales,
}


def _split(select: str) -> list[str]:
    """The expressions of a select list, at commas outside brackets, quotes and CASE."""
    out, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(select):
        quoted ^= c == "'"
        if not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(select[at:k])
                at = k + 1
    return [x.strip() for x in [*out, select[at:]]]


def _clean(x: str) -> str:
    t = f"translate(coalesce({x}, ''), '‐‑‒', '---')"
    return f"regexp_replace({NORM.format(f"CASE WHEN regexp_matches({t}, '{na.WORD_PREFIX}') THEN regexp_replace(regexp_replace({t}, '{na.WORD_PREFIX}', ''), '\\.[^.]*$', '') ELSE {t} END")}, '[. ]+$', '')"


_TOKENS = r"list_filter(string_split_regex({0}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_BOXES = "(SELECT key, n, p AS x0, q + 2 AS y0, p + 9 AS x1, q + 11 AS y1 FROM " + st._E + ")"
_GLYPHS = "(SELECT l_orderkey AS key, l_linenumber AS ord, (min(l_suppkey) % 40)::DOUBLE AS x0, min(l_suppkey) % 40 + 3.0::DOUBLE AS x1, min(l_quantity)::DOUBLE AS y FROM lineitem GROUP BY 1, 2)"

ORACLES = {
    "turned_places": f"""SELECT l_orderkey, l_linenumber, round(CASE r WHEN 1 THEN (y - 20) * 1.5 WHEN 2 THEN 918 - (x - 10) * 1.5 WHEN 3 THEN 1188 - (y - 20) * 1.5 ELSE (x - 10) * 1.5 END::DOUBLE, 6) AS x,
 round(CASE r WHEN 1 THEN (x - 10) * 1.5 WHEN 2 THEN (y - 20) * 1.5 WHEN 3 THEN 918 - (x - 10) * 1.5 ELSE 1188 - (y - 20) * 1.5 END::DOUBLE, 6) AS y, true AS returns FROM (SELECT {TURNED} FROM lineitem)""",
    "constrained_steps": """SELECT l_orderkey, l_linenumber, CASE WHEN h < 1e-9 THEN dx ELSE round(h * cos(a), 4) + 0.0 END AS dx, CASE WHEN h < 1e-9 THEN dy ELSE round(h * sin(a), 4) + 0.0 END AS dy
 FROM (SELECT *, sqrt(dx * dx + dy * dy) AS h, round_even(atan2(dy, dx) / (pi() / 4), 0) * (pi() / 4) AS a FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE - 25 AS dx, (l_suppkey % 50 - 25)::DOUBLE AS dy FROM lineitem))""",
    "crossings": f"SELECT key, sid, sid2, x, y FROM {st.CROSSINGS}",
    "named_sizes": """SELECT p_partkey, round(CASE WHEN land THEN h ELSE w END * (72 / 25.4::DOUBLE), 3) AS width, round(CASE WHEN land THEN w ELSE h END * (72 / 25.4::DOUBLE), 3) AS height
 FROM (SELECT p_partkey, p_size % 2 = 0 AS land, p_size % 6 AS k FROM part) LEFT JOIN (VALUES (4, 210, 297), (3, 297, 420), (2, 420, 594), (1, 594, 841)) AS v(k, w, h) USING (k)""",
    "measured_values": "SELECT p_partkey, CASE WHEN p_partkey % 100 > 0 THEN format('{:,.1f} cm²', p_size * (25.4::DOUBLE / 72 * (p_partkey % 100) / 1.0 / 10.0)) END AS area FROM part",
    "document_titles": f"""SELECT doc_id, coalesce(nullif(CASE WHEN regexp_matches(s, '{na.PLACEHOLDER}') THEN '' ELSE s END, ''), nullif({_clean("running")}, ''), nullif({_clean("regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')")}, ''), 'Untitled') AS title
 FROM (SELECT *, {_clean("stated")} AS s FROM (SELECT {TITLES} FROM documents))""",
    "citations": """SELECT n_nationkey, CASE WHEN a THEN 'Annex ' ELSE '' END || number || CASE WHEN t = '' THEN '' ELSE '  ' || t END AS shown,
 'Code, ' || CASE WHEN a THEN 'Annex ' ELSE 'cl. ' END || number || CASE WHEN t = '' THEN '' ELSE ' (' || t || ')' END || ', p. ' || page AS clause, CASE WHEN t = '' THEN '' ELSE '“' || t || '”' || chr(10) || '— ' END || 'Code, cl. ' || number || ', p. ' || page AS passage
 FROM (SELECT n_nationkey, n_nationkey % 3 = 0 AS a, CASE WHEN n_nationkey % 3 = 0 THEN chr(65 + n_nationkey) ELSE concat('6.', n_nationkey) END AS number, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS t, n_regionkey::VARCHAR AS page FROM nation)""",
    "scramble_reasons": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'stacked layout (fraction, root or stacked index) flattened in drawing order' WHEN o_orderkey % 5 = 1 THEN 'operators with nothing to operate on — terms are out of order'
 WHEN o_orderkey % 5 = 2 THEN 'subscripts printed apart from their symbols' WHEN o_orderkey % 5 = 3 THEN 'mostly one- and two-character fragments' END AS reason FROM orders""",
    "flattened_tables": f"""SELECT doc_id, CASE WHEN pos > 0 THEN coalesce(regexp_extract_all(array_to_string(t[:pos - 1], ' '), '{na.TABLE_NAME}')[-1], nullif(regexp_extract(text, '{na.TABLE_NAME}'), ''), 'unnamed table') END AS table_name
 FROM (SELECT *, strpos(array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '{na.TABLE_VALUE}') THEN 'v' ELSE '.' END), ''), repeat('v', {na.TABLE_RUN})) AS pos FROM (SELECT *, {_TOKENS.format("text")} AS t FROM (SELECT {TABLED} FROM documents)))""",
    "occurrence_ids": "SELECT doc_id, lang || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)",
    "cross_references": f"""WITH r AS (SELECT s_suppkey + 1000 AS page_no, concat(s_nationkey % 5 + 1, '.', s_nationkey + 1) AS p, s_suppkey % 100 AS k, s_suppkey % 7 AS m FROM supplier), t AS {st._TREE}
 SELECT r.page_no, concat('Clause ', p, '.', k) AS label, coalesce(a.page_no, b.page_no) AS target FROM r LEFT JOIN t a ON a.number = p LEFT JOIN t b ON b.number = split_part(p, '.', 1) WHERE coalesce(a.number, b.number) IS NOT NULL
 UNION ALL SELECT page_no, concat('Annex ', chr((65 + m)::INT)), r_regionkey + 200 FROM r JOIN region ON r_regionkey = m UNION ALL SELECT page_no, concat('Table ', m, '.1'), r_regionkey + 300 FROM r JOIN region ON r_regionkey = m""",
    "annexes_and_captions": "SELECT chr(65 + r_regionkey) AS name, '' AS title, r_regionkey + 200 AS page_no FROM region UNION ALL SELECT concat(chr(65 + r_regionkey), '.', r_regionkey + 1), 'Rules', r_regionkey + 200 FROM region UNION ALL SELECT concat('Table ', r_regionkey, '.1'), '', r_regionkey + 300 FROM region",
    "repaired_glyphs": "SELECT s_nationkey AS doc_id, s_suppkey AS page_no, 0 AS line_no, s_name AS text, CASE WHEN s_suppkey % 2 = 1 THEN length(replace(s_name, ' ', '')) ELSE 0 END AS dropped FROM supplier",
    "revised_pages": """WITH o AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, text FROM documents)
 SELECT book, page_no, 'changed' AS change FROM o WHERE page_no % 5 = 0 AND page_no > 0 AND text IS NOT NULL UNION ALL SELECT DISTINCT book, 0, 'removed' FROM o UNION ALL SELECT DISTINCT book, -1, 'added' FROM o""",
    "nearest_boxes": f"""SELECT key, pid, r.n AS ord, r.o = 0 AS inside FROM (SELECT p.key, p.n AS pid, min(CASE WHEN p.p BETWEEN x0 AND x1 AND p.q + 2 BETWEEN y0 AND y1 THEN {{'o': 0, 'f': 0.0::DOUBLE, 'n': b.n}}
 ELSE {{'o': 1, 'f': (p.p - (x0 + x1) / 2) ** 2 + (p.q + 2 - (y0 + y1) / 2) ** 2, 'n': b.n}} END) AS r FROM {st._E} p JOIN {_BOXES} b USING (key) GROUP BY 1, 2)""",
    "recent_paths": "SELECT user_id, ord, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, lower(event_type)) AS ord FROM events GROUP BY 1, 2) WHERE ord <= 12",
    "bookmark_targets": """WITH k AS (SELECT DISTINCT s_nationkey AS n FROM supplier) SELECT 0 AS doc_id, n_nationkey AS node, n_name AS title, n_nationkey + 100 AS new_page,
 CASE WHEN n_nationkey > 1 THEN CASE WHEN n_nationkey // 2 IN (SELECT n FROM k) THEN n_nationkey // 2 WHEN 0 IN (SELECT n FROM k) THEN 0 END END AS parent FROM nation WHERE n_nationkey IN (SELECT n FROM k)""",
    "visiting_order": "SELECT book, page_no, ((page_no - 2) % n + n) % n AS visit FROM (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, count(*) OVER (PARTITION BY source) AS n FROM documents)",
    "running_totals": "SELECT o_custkey AS folder, o_orderkey AS file, o_orderkey % 3 AS hits, count(*) OVER w AS files_done, (sum(o_orderkey % 3) OVER w)::BIGINT AS hits_done, count(*) FILTER (o_orderkey % 3 > 0) OVER w AS with_hits FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "distinct_coordinates": f"SELECT key, unnest(l) AS at, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT key, list_reduce(list_transform(list(y ORDER BY y), lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 2 THEN list_concat(a, b) ELSE a END) AS l FROM {_GLYPHS} GROUP BY 1)",
    "text_runs": f"""WITH g AS (SELECT *, coalesce((x0 > max(x1) OVER (PARTITION BY key ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2.4)::INT, 0) AS s FROM {_GLYPHS}),
 r AS (SELECT *, (sum(s) OVER (PARTITION BY key ORDER BY x0, ord ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM g) SELECT key, 0 AS row, run, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "text_columns": f"SELECT key, l[len(l) // 10 + 1] AS x0, r[least(len(r) - 1, len(r) * 9 // 10) + 1] AS x1, w[len(w) // 2 + 1] AS median_width FROM (SELECT key, list(x0 ORDER BY x0) AS l, list(x1 + y ORDER BY x1 + y) AS r, list(x1 + y - x0 ORDER BY x1 + y - x0) AS w FROM {_GLYPHS} GROUP BY 1)",
    "effective_scales": "SELECT o_custkey AS doc_id, o_orderkey AS page_no, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 1.0::DOUBLE END AS scale FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
