"""Queries on annotations, outlines, regions, exports and page lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as gr
from ..functions import lines as ln
from ..operators import analysis as an
from ..operators import annotations as no
from ..operators import exports as ex
from ..operators import page_regions as pr
from ..operators import regions as rg
from ..operators import revisions as rv
from ..sources.files import decoded
from ..sources.tables import lines, table
from .fixtures import MARKS, NORM, case_lines, marks, marks_sql

# Expressions that Spark and the SQL read alike, over one mark each (k, n, a, b, q, f).
BOX = ("k AS key", "n AS id", "a AS x0", "q * 3 AS y0", "a + b / 3 AS x1", "q * 3 + a / 2 AS y1")
BY_KIND = "CASE CAST(b AS INT) % 5 WHEN 0 THEN 'Comment' WHEN 1 THEN 'Highlight' WHEN 2 THEN 'MeasureArea' WHEN 3 THEN 'Tick' ELSE 'Other' END"
NOTES = ("k AS doc_id", "CAST(q AS INT) % 4 AS page_no", f"{BY_KIND} AS kind", "CASE WHEN f = 'N' THEN ' ' ELSE f END AS text", "CASE WHEN f = 'R' THEN NULL ELSE CAST(a AS INT) % 2 END AS n_replies")
URL = "CASE CAST(b AS INT) % 4 WHEN 0 THEN 'HTTPS://x.example' WHEN 1 THEN 'mailto:a' WHEN 2 THEN 'ftp' ELSE 'file:///x' END AS target"
LINKS = ("k AS page", "n AS id", "a * 9 AS x0", "q * 9 AS y0", "a * 9 + b / 4 AS x1", "q * 9 + a / 8 AS y1", URL)
SHAPE = """concat('{"Kind":"', CASE f WHEN 'N' THEN 'MeasureArea' WHEN 'R' THEN 'Line' ELSE 'Ink' END, '","Box":[', CAST(CAST(a AS INT) AS STRING), ',2', CASE WHEN n = 3 THEN '' ELSE ',3,4' END, '],"Leader":[[1,2]', CASE WHEN n % 2 = 0 THEN ',[3,4],[5,6]' ELSE ',[7]' END,
 '],"Upp":', CAST(CAST(q AS INT) % 3 AS STRING), ',"Unit":"m","Dec":', CAST(CAST(b AS INT) % 9 AS STRING), CASE WHEN n = 5 THEN '' ELSE '}' END)"""
RULES = ("k AS key", "CASE WHEN n % 2 = 0 THEN a ELSE a * 2 END AS x0", "CASE WHEN n % 2 = 0 THEN q ELSE q * 2 END AS y0", "CASE WHEN n % 2 = 0 THEN a + b / 2 ELSE a * 2 + 1 END AS x1", "CASE WHEN n % 2 = 0 THEN q + 1 ELSE q * 2 + b / 2 END AS y1")
AREA = ("k AS key", "5.0D AS x0", "5.0D AS y0", "60.0D AS x1", "80.0D AS y1")
LINE = ("k AS key", "n AS line", "a AS x0", "q * 4 AS y0", "a + 30 AS x1", "q * 4 + 6 AS y1", "CASE WHEN f = 'R' THEN 'Table 3.1 Values' WHEN f = 'A' AND n % 5 = 0 THEN 'some words that make this line read like prose here' ELSE concat('v ', n) END AS text")
#: Equations with the boxes of their labels, and lines of which one is in a margin.
EQUATION = ("k AS key", "n AS eq", "a AS x0", "q * 4 AS y0", "a + 20 AS x1", "q * 4 + 9 AS y1", "a + 60 AS lx0", "q * 4 + 1 AS ly0", "a + 70 AS lx1", "q * 4 + 8 AS ly1")
MARGINED = (*LINE, "n = 7 AS margin")
REGION = ("k AS key", "n AS region", "n + 1 AS caption_line", "a - 5 AS x0", "q * 4 - 6 AS y0", "a + 25 AS x1", "q * 4 + 10 AS y1")
CHARS = ("k AS key", "n AS seq", "f AS ch", "a AS x0", "n DIV 3 * 20.0D AS y0", "a + 6 AS x1", "n DIV 3 * 20.0D + 8 AS y1")
WORDS = ("k AS key", "CASE WHEN f = 'A' THEN ' ' ELSE concat(f, n) END AS word", "b AS confidence", "a * 10 AS x", "q * 20 AS y", "b AS w", "a AS h", "612.0D AS page_width", "792.0D AS page_height", "2550.0D AS px_width", "3300.0D AS px_height", "10.0D AS ox", "20.0D AS oy")
CHUNKS = ("k AS doc_id", "CAST(q AS INT) AS page_no", "CAST(b AS INT) AS token_estimate", "CASE CAST(a AS INT) % 3 WHEN 0 THEN 'suspect' WHEN 1 THEN 'check' ELSE 'ok' END AS quality")
ITEMS = ("k AS doc_id", "CASE n WHEN 1 THEN 'heading' WHEN 2 THEN 'table' WHEN 3 THEN 'figure' WHEN 4 THEN 'equation' WHEN 5 THEN 'image' ELSE 'paragraph' END AS kind", "CASE WHEN f = 'R' THEN 'suspect' ELSE 'ok' END AS quality", "b > 45 AS clipped")
PRINTED = "CASE CAST(b AS INT) % 6 WHEN 0 THEN concat('6.4.', n, ' Punching shear 103') WHEN 1 THEN concat('1.', n, ' Gk') WHEN 2 THEN concat('6.', n, '. General') WHEN 3 THEN 'It ends. Then it goes on' WHEN 4 THEN 'A sentence.' ELSE concat('Figure 2.', n, ' Stress') END"


def _plain(*columns):
    """The same expressions for the SQL: a double is written 5.0."""
    return marks_sql(*[c.replace(".0D", ".0::DOUBLE").replace("AS STRING", "AS VARCHAR").replace(" DIV ", " // ") for c in columns])


def _case_clauses(s, d):
    return an.clauses(case_lines(s, d))


ENTRIES = "CASE WHEN doc_id % 3 = 0 AND line_no % 6 < 5 THEN concat(text, ' abc 12') WHEN doc_id % 4 = 1 AND line_no % 6 < 5 THEN concat(text, ' ....') ELSE text END"
DOC_LINES = f"(SELECT doc_id, line_no // 6 AS page_no, line_no, {ENTRIES} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents))"
ODD = "text || CASE WHEN doc_id % 3 = 0 THEN ' � �' WHEN doc_id % 3 = 1 THEN ' हि' ELSE '' END"


def _doc_lines(s, d):
    return lines(table(s, d, "documents")).selectExpr("doc_id", "line_no div 6 as page_no", "line_no", f"{ENTRIES} as text")


def _struct(df, name, columns):
    return df.select("*", F.struct(*columns).alias(name))


def _boxes(s, d):
    m = marks(s, d, "k", "n", "a", "b", "q", "f").selectExpr("k", "n", "named_struct('l', 0D, 'b', 0D, 'r', 60D, 't', 80D) as media", "named_struct('l', if(f = 'A', null, a - 10), 'b', q - 20, 'r', a + b, 't', q + 9) as crop")
    return m.select("k", "n", no.page_box(F.col("media"), F.col("crop")).alias("p")).select("k", "n", "p.*")


def _shapes(s, d):
    return marks(s, d, "k", "n", f"{SHAPE} AS j").select("k", "n", no.decode_shape(F.col("j")).alias("s")).where("s is not null").selectExpr("k", "n", "s.kind", "size(s.points) as n_points", "s.units_per_point as upp", "s.decimals")


def _overlay(s, d):
    own = marks(s, d, *LINKS).where("id % 2 = 0")
    return no.page_overlay(own, marks(s, d, *LINKS).where("id % 2 = 1"), marks(s, d, *LINKS).where("id = 4").selectExpr("page", "id", "x0", "y0", "x1", "y1", "'clause' as target"))


def _watermarks(s, d):
    rows = marks(s, d, "k % 50 AS doc_id", "CAST(q AS INT) AS page_no", "f AS bytes", "b AS width", "b + a AS height", "80.0D AS page_width", "90.0D AS page_height", "a > 3 AS has_body")
    return no.image_watermarks(rows.withColumn("bytes", F.col("bytes").cast("binary")))


def _changes(s, d):
    """Documents against a revision: every eleventh is gone, others have lines dropped, changed and added."""
    old = table(s, d, "documents").selectExpr("doc_id", "0 AS page_no", "text")
    kept = F.expr("transform(filter(split(text, '\n'), (x, i) -> (i + doc_id) % 9 <> 4), (x, i) -> CASE WHEN (i + doc_id) % 13 = 5 THEN concat(x, ' new') ELSE x END)")
    new = old.where("doc_id % 11 <> 3").withColumn("text", F.array_join(F.when(F.col("doc_id") % 3 == 0, F.concat(kept, F.array(F.lit("one more")))).otherwise(F.split("text", "\n")), "\n"))
    return rv.page_changes(old, new)


def _separators(s, d):
    labels = marks(s, d, "k AS key", "n", "q").groupBy("key").agg(F.max("q").alias("m")).selectExpr("key", "m * 4 + 20 as hi", "m * 2 - 10 as lo")
    return rg.separators(labels, marks(s, d, "k AS key", "q * 4 AS y0", "q * 4 + a / 4 AS y1"))


def _titles(s, d):
    files = table(s, d, "documents").selectExpr("doc_id", "concat('/in/', lang, '_', source, '-', doc_id, '.txt') as path")
    outlines = table(s, d, "documents").where("doc_id % 4 = 0").selectExpr("doc_id", "0 as ord", "if(doc_id % 8 = 0, ' ', concat('Outline  of ', source)) as title")
    return ex.suggested_titles(files, outlines, _doc_lines(s, d).where("doc_id % 3 > 0"))


def _markers(s, d):
    paragraphs = _doc_lines(s, d).selectExpr("doc_id", "page_no", "line_no as seq", "text")
    marks_ = _doc_lines(s, d).where("line_no % 2 = 0").selectExpr("doc_id", "page_no", "line_no as ord", "if(line_no % 4 = 0, replace(substr(text, 1, 60), 'a', 'A'), concat('none ', line_no)) as title")
    return ex.marker_paragraphs(marks_, paragraphs)


def _books(s, d):
    return table(s, d, "orders").selectExpr("o_custkey as book", "o_orderkey as doc_id")


def _numbered(s, d):
    from pyspark.sql import Window as W

    return _books(s, d).withColumn("page_no", F.row_number().over(W.partitionBy("book").orderBy("doc_id")) - 1)


_NUMBERED = "(SELECT o_custkey AS book, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_no FROM orders)"

QUERIES = {
    "document_metadata": lambda s, d: no.metadata(table(s, d, "events").selectExpr("event_id as doc_id", "nullif(event_type, 'click') as title", "cast(user_id as string) as author", "if(value > 50, null, 'k') as keywords")),
    "page_labels": lambda s, d: marks(s, d, "k", "n", "CASE WHEN f = 'A' THEN CAST(n AS STRING) WHEN f = 'N' THEN ' ' ELSE concat('A-', n) END AS l").select("k", "n", no.page_label(F.col("l"), F.col("n") - 1).alias("label")),
    "page_boxes": _boxes,
    "outline_caps": lambda s, d: no.outline(table(s, d, "lineitem").selectExpr("l_suppkey % 3 as doc_id", "l_orderkey * 4 + l_linenumber % 4 as node", "l_orderkey as ord", "l_linenumber * 6 as depth", "concat('Part ', l_orderkey) as title", "0 as page_no")).select("doc_id", "node", "ord", "at"),
    "annotation_counts": lambda s, d: no.annotation_counts(marks(s, d, *NOTES)),
    "kind_labels": lambda s, d: marks(s, d, f"{BY_KIND} AS kind").select("kind", no.kind_label(F.col("kind")).alias("label")).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")),
    "shapes": _shapes,
    "page_overlay": lambda s, d: _overlay(s, d).select("page", "id", "kind", "target", "ord"),
    "image_watermarks": _watermarks,
    "watermark_order": lambda s, d: no.ordered_watermarks(marks(s, d, "k AS doc_id", "concat('image ', n) AS label", "CAST(a AS INT) % 3 AS on_pages").where("label < 'image 3'"), marks(s, d, "k AS doc_id", "repeat('t', CAST(b AS INT) % 7 + 1) || n AS label", "CAST(a AS INT) % 4 AS on_pages")).select("doc_id", "label", "ord"),
    "usable_graphics": lambda s, d: rg.usable_graphics(marks(s, d, "k", "n", "a AS x0", "q * 3 AS y0", "a + b - 10 AS x1", "q * 3 + b - 5 AS y1"), 100.0, 160.0).select("k", "n"),
    "ruling_lines": lambda s, d: rg.ruling_lines(marks(s, d, *RULES), marks(s, d, *AREA).distinct()),
    "rule_bands": lambda s, d: rg.bands(rg.ruling_lines(marks(s, d, *RULES), marks(s, d, *AREA).distinct())),
    "line_owners": lambda s, d: rg.line_owners(marks(s, d, *LINE), marks(s, d, *REGION).where("region <= 3")),
    "free_equations": lambda s, d: rg.free_equations(marks(s, d, *BOX), marks(s, d, *REGION).where("region <= 2")).select("key", "id"),
    "text_blocks": lambda s, d: rg.text_block_below(marks(s, d, *LINE), marks(s, d, *LINE).where("text like 'Table%'").withColumnRenamed("line", "caption")),
    "separators": _separators,
    "merged_rects": lambda s, d: rg.merged_rects(marks(s, d, *CHARS), "key"),
    "selected_text": lambda s, d: rg.selection(marks(s, d, *CHARS), marks(s, d, "k AS key", "n", "CAST(b AS INT) % 5 AS first", "CAST(q AS INT) % 7 AS last").where("n = 1"))[0],
    "selected_rects": lambda s, d: rg.selection(marks(s, d, *CHARS), marks(s, d, "k AS key", "n", "CAST(b AS INT) % 5 AS first", "CAST(q AS INT) % 7 AS last").where("n = 1"))[1],
    "flow_order": lambda s, d: rg.flow_order(marks(s, d, *LINE), marks(s, d, *REGION).where("region <= 3")),
    "caption_regions": lambda s, d: pr.caption_regions(marks(s, d, *LINE).where("text like 'Table%'").selectExpr("key", "line as caption", "if(line % 2 = 0, 'Table', 'Figure') as kind", "x0", "y0", "x1", "y1"), marks(s, d, *BOX), 220.0),
    "page_regions": lambda s, d: pr.page_regions(marks(s, d, *MARGINED), marks(s, d, *BOX).where("id % 2 = 1"), 220.0).drop("title", "lines"),
    "display_blocks": lambda s, d: pr.display_blocks(marks(s, d, *EQUATION).where("eq % 3 = 0"), marks(s, d, *MARGINED).drop("line"), marks(s, d, *BOX).where("id % 4 = 1"), 120.0, 230.0),
    "page_changes": _changes,
    "column_gaps": lambda s, d: rg.column_gaps(marks(s, d, "k AS key", "CAST(q AS INT) % 3 AS row", "a * 2 AS x0", "a * 2 + 10 AS x1"), 0.0, 100.0, 1.0),
    "union_boxes": lambda s, d: rg.union_box(marks(s, d, *BOX), "key"),
    "upright_glyphs": lambda s, d: marks(s, d, "k", "n", "a / 10 - 0.2 AS angle").where(rg.is_upright(F.col("angle"))).select("k", "n"),
    "margin_lines": lambda s, d: marks(s, d, *LINE).where(rg.in_margin(F.col("y0"), F.col("y1"), F.lit(160.0))).select("key", "line"),
    "recognised_words": lambda s, d: rg.recognised_words(marks(s, d, *WORDS)).select("key", "word", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")]),
    "pixel_sizes": lambda s, d: marks(s, d, "k", "n", "a * 40 AS w", "b * 30 AS h").select("k", "n", rg.pixel_size(F.col("w"), F.col("h")).alias("p")).select("k", "n", "p.*"),
    "measure_ends": lambda s, d: marks(s, d, "k", "n", "a", "q", "CASE WHEN f = 'A' THEN a ELSE b END AS x1").select("k", "n", F.posexplode(rg.end_ticks(F.col("a"), F.col("q"), F.col("x1"), F.col("q"))).alias("end", "t")).select("k", "n", "end", *[F.round(f"t.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")]),
    "measure_boxes": lambda s, d: _struct(marks(s, d, *BOX), "bounds", ["x0", "y0", "x1", "y1"]).select("key", "id", rg.appearance_box(F.col("bounds"), rg.caption_box(F.col("x0"), F.col("y1"), F.col("x1")), F.lit(1.5)).alias("p")).select("key", "id", "p.*"),
    "contents_pages": lambda s, d: ex.contents_pages(_doc_lines(s, d), "doc_id", "page_no"),
    "suspect_pages": lambda s, d: ex.suspect_pages(table(s, d, "documents").selectExpr("doc_id", "0 as page_no", f"{ODD} as text")),
    "section_counts": lambda s, d: ex.section_counts(_doc_lines(s, d), _doc_lines(s, d).where("doc_id % 2 = 0").selectExpr("doc_id", "page_no % 3 as section")),
    "export_summary": lambda s, d: ex.export_summary(marks(s, d, *CHUNKS)),
    "html_counters": lambda s, d: ex.html_counters(marks(s, d, *ITEMS)),
    "equation_quality": lambda s, d: marks(s, d, "k", "n", "f").select("k", "n", ex.equation_quality(F.filter(F.array("f"), lambda x: x == "R")).alias("quality")),
    "chunk_equations": lambda s, d: ex.chunk_equations(marks(s, d, "k AS doc_id", "n AS chunk_index", "n AS first_page", "n + 1 AS last_page", "concat('by ( ', CAST(q AS INT) % 3, ' ) and') AS text"), marks(s, d, "k AS doc_id", "n AS page_no", "concat('(', CAST(b AS INT) % 3, ')') AS label")),
    "valid_hits": lambda s, d: ex.valid_hits(marks(s, d, "k AS doc_id", "n AS page_no", "CAST(q AS INT) - 3 AS char_start", "CAST(a AS INT) % 5 AS length"), marks(s, d, "k AS doc_id", "n AS page_no", "repeat('x', CAST(b AS INT)) AS text")),
    "same_texts": lambda s, d: ex.same_texts(table(s, d, "documents").selectExpr("doc_id", "text", "doc_id % 2 as n_pages")),
    "sub_headings": lambda s, d: ex.sub_headings(_case_clauses(s, d)),
    "kept_outlines": lambda s, d: ex.kept_outlines(_case_clauses(s, d).unionByName(_case_clauses(s, d).where("number = '7'").withColumn("doc_id", F.lit(9)))).groupBy("doc_id", "n_clauses").agg(F.count(F.lit(1)).alias("n")),
    "suggested_titles": _titles,
    "inserted_pages": lambda s, d: ex.insert_pages(_numbered(s, d), _numbered(s, d).where("page_no < 2 and book % 2 = 0"), 3),
    "merged_pages": lambda s, d: ex.merged_pages(_numbered(s, d).withColumnRenamed("book", "file"), table(s, d, "customer").selectExpr("c_custkey as file", "-c_custkey as ord")),
    "extracted_pages": lambda s, d: ex.extract_pages(_numbered(s, d), _numbered(s, d).where("doc_id % 3 = 0").unionByName(_numbered(s, d).where("doc_id % 6 = 0"))),
    "moved_files": lambda s, d: ex.moved(_numbered(s, d).selectExpr("book as set_id", "doc_id as file", "page_no as ord"), 1, 4),
    "pending_files": lambda s, d: ex.pending_files(table(s, d, "documents").selectExpr("doc_id as path", "md5(text) as hash"), table(s, d, "documents").where("doc_id % 3 = 0").selectExpr("doc_id as path", "if(doc_id % 2 = 0, md5(text), 'old') as hash")),
    "marker_paragraphs": lambda s, d: _markers(s, d).select("doc_id", "page_no", "ord", "seq"),
    "live_markers": lambda s, d: ex.live_markers(_markers(s, d)).select("doc_id", "page_no", "ord"),
    "printed_headings": lambda s, d: marks(s, d, "k", "n", f"{PRINTED} AS t").select("k", "n", ln.printed_heading(F.col("t")).alias("printed"), ln.is_standalone_heading(F.col("t")).alias("alone"), ln.is_region_caption(F.col("t")).alias("caption"), ln.is_beside_formula(F.col("t")).alias("beside")),
    "read_files": lambda s, d: decoded(table(s, d, "documents").selectExpr("cast(doc_id as string) as path", "case when doc_id % 5 = 0 then X'' when doc_id % 5 = 1 then X'FF' else cast(text as binary) end as content")).select("path", F.length("text").alias("n_chars"), "error"),
}

_RULES = f"""WITH e AS (SELECT DISTINCT key, CASE WHEN y1 - y0 <= 1.5 AND x1 - x0 BETWEEN 6 AND 67 THEN 'y' WHEN x1 - x0 <= 1.5 AND y1 - y0 BETWEEN 6 AND 87 THEN 'x' END AS axis, CASE WHEN y1 - y0 <= 1.5 AND x1 - x0 BETWEEN 6 AND 67 THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS p
 FROM {_plain(*RULES)} WHERE x1 >= 2 AND x0 <= 63 AND y1 >= 2 AND y0 <= 83), l AS (SELECT key, axis, list_reduce(list_prepend([]::DOUBLE[], list_transform(list_sort(list(p)), lambda x: [x])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] > 2 THEN list_concat(acc, x) ELSE acc END) AS kept FROM e WHERE axis IS NOT NULL GROUP BY 1, 2), r AS (SELECT key, axis, unnest(kept) AS p FROM l)"""
_SELECTED = f"(SELECT c.* FROM {_plain(*CHARS)} c JOIN (SELECT k, least(b::INT % 5, q::INT % 7) AS a, greatest(b::INT % 5, q::INT % 7) AS z FROM {MARKS} WHERE n = 1) e ON e.k = c.key AND c.seq BETWEEN a AND z)"

ORACLES = {
    "document_metadata": "SELECT event_id AS doc_id, coalesce(nullif(event_type, 'click'), '') AS title, user_id::VARCHAR AS author, '' AS subject, CASE WHEN value > 50 THEN '' ELSE 'k' END AS keywords, '' AS creator, '' AS producer, '' AS created, '' AS modified FROM events",
    "page_labels": f"SELECT k, n, CASE WHEN f = 'R' THEN concat('A-', n) END AS label FROM {MARKS}",
    "page_boxes": f"""WITH c AS (SELECT k, n, f <> 'A' AND least(a + b, 60) > greatest(a - 10, 0) AND least(q + 9, 80) > greatest(q - 20, 0) AS ok, greatest(a - 10, 0) AS l, greatest(q - 20, 0) AS b, least(a + b, 60) AS r, least(q + 9, 80) AS t FROM {MARKS})
 SELECT k, n, CASE WHEN ok THEN l ELSE 0 END AS x, CASE WHEN ok THEN b ELSE 0 END AS y, CASE WHEN ok THEN r - l ELSE 60 END AS width, CASE WHEN ok THEN t - b ELSE 80 END AS height FROM c""",
    "outline_caps": """WITH n AS (SELECT l_suppkey % 3 AS doc_id, l_orderkey * 4 + l_linenumber % 4 AS node, l_orderkey AS ord, min(l_linenumber) FILTER (true) AS any_line, count(*) AS c, min(l_linenumber * 6) AS lo, max(l_linenumber * 6) AS hi FROM lineitem GROUP BY 1, 2, 3)
 SELECT * FROM (SELECT doc_id, node, ord, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, node) - 1)::INT AS "at" FROM n WHERE lo < 32) WHERE "at" < 8000""",
    "annotation_counts": f"SELECT doc_id, page_no, count(*) AS annotations, count(*) FILTER (kind = 'Comment' OR (kind = 'Highlight' AND (text IN ('A', 'R') OR n_replies > 0))) AS comments, coalesce(sum(n_replies), 0)::BIGINT AS replies FROM {_plain(*NOTES)} GROUP BY 1, 2",
    "kind_labels": f"SELECT kind, CASE kind WHEN 'Comment' THEN 'Note' WHEN 'MeasureArea' THEN 'Area' WHEN 'Other' THEN 'Annotation' ELSE kind END AS label, count(*) AS n FROM {_plain(f'{BY_KIND} AS kind')} GROUP BY 1, 2",
    "shapes": f"""WITH j AS (SELECT k, n, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM {_plain('k', 'n', f'{SHAPE} AS j')}), s AS (SELECT k, n, j->>'Kind' AS kind, json_array_length(j->'Box') AS box, len(list_filter(CAST(j->'Leader' AS DOUBLE[][]), lambda p: len(p) = 2)) AS n_points, (j->>'Upp')::DOUBLE AS upp, (j->>'Dec')::INT AS dec FROM j WHERE j IS NOT NULL)
 SELECT k, n, kind, n_points::INT AS n_points, CASE WHEN kind = 'MeasureArea' AND upp > 0 THEN upp END AS upp, CASE WHEN kind = 'MeasureArea' AND upp > 0 THEN greatest(0, least(6, dec)) END AS decimals FROM s WHERE box = 4 AND kind <> 'Ink' AND n_points >= CASE kind WHEN 'MeasureArea' THEN 3 ELSE 1 END""",
    "page_overlay": f"""WITH l AS (SELECT * FROM {_plain(*LINKS)} WHERE x1 - x0 >= 1 AND y1 - y0 >= 1), o AS (SELECT page, id, target, 0 AS kind FROM l WHERE id % 2 = 0 UNION ALL SELECT page, id, target, 1 FROM l w WHERE id % 2 = 1 AND regexp_matches(lower(target), '^(http|mailto:|ftp)') AND length(target) >= 4
 AND NOT EXISTS (SELECT 1 FROM l a WHERE a.page = w.page AND a.id % 2 = 0 AND w.x0 < a.x1 AND a.x0 < w.x1 AND w.y0 < a.y1 AND a.y0 < w.y1) UNION ALL SELECT page, id, 'clause', 2 FROM l WHERE id = 4) SELECT page, id, kind, target, (row_number() OVER (PARTITION BY page ORDER BY kind, id) - 1)::INT AS ord FROM o""",
    "image_watermarks": f"SELECT k % 50 AS doc_id, upper(sha256(f)) AS sha256, count(DISTINCT q) AS on_pages, bool_and(a > 3) AS safe FROM {MARKS} WHERE b >= 80 * 0.88 AND a + b >= 90 * 0.88 GROUP BY 1, f, 2 HAVING count(DISTINCT q) >= 3",
    "watermark_order": f"""SELECT doc_id, label, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, p DESC, length(label) DESC, label) - 1)::INT AS ord FROM (SELECT k AS doc_id, concat('image ', n) AS label, a::INT % 3 AS p, 0 AS kind FROM {MARKS} WHERE concat('image ', n) < 'image 3' UNION ALL SELECT k, repeat('t', b::INT % 7 + 1) || n, a::INT % 4, 1 FROM {MARKS})""",
    "usable_graphics": f"SELECT k, n FROM {MARKS} WHERE b >= 10 AND (b - 10) * (b - 5) < 8000 AND q * 3 < 160 * 0.92 AND q * 3 + b - 5 > 160 * 0.08",
    "ruling_lines": f"{_RULES} SELECT key, axis, p AS \"at\" FROM r",
    "rule_bands": f"{_RULES} SELECT * FROM (SELECT key, axis, p AS start, lead(p) OVER (PARTITION BY key, axis ORDER BY p) AS \"end\" FROM r) WHERE \"end\" - start > 2",
    "line_owners": f"""WITH l AS (SELECT * FROM {_plain(*LINE)}), r AS (SELECT * FROM {_plain(*REGION)} WHERE region <= 3) SELECT l.key, l.line, coalesce(min(r.region) FILTER (l.line = caption_line), min(r.region)) AS region
 FROM l LEFT JOIN r ON r.key = l.key AND (l.line = caption_line OR ((l.x0 + l.x1) / 2 BETWEEN r.x0 - 1 AND r.x1 + 1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 1 AND r.y1 + 1)) GROUP BY 1, 2""",
    "free_equations": f"SELECT e.key, e.id FROM {_plain(*BOX)} e WHERE NOT EXISTS (SELECT 1 FROM {_plain(*REGION)} r WHERE r.region <= 2 AND r.key = e.key AND (e.x0 + e.x1) / 2 BETWEEN r.x0 AND r.x1 AND (e.y0 + e.y1) / 2 BETWEEN r.y0 AND r.y1)",
    "text_blocks": f"""WITH l AS (SELECT * FROM {_plain(*LINE)}), u AS (SELECT c.line AS caption, c.y0 AS below, l.* FROM l JOIN l c ON c.key = l.key AND c.text LIKE 'Table%' AND l.line <> c.line AND l.y1 <= c.y0 + 1),
 b AS (SELECT *, least(below, coalesce(min(y0) OVER (PARTITION BY key, caption ORDER BY y1 DESC, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), below)) AS bottom FROM u),
 s AS (SELECT *, sum((bottom - y1 > 13.2 OR text LIKE 'Table%' OR text LIKE 'some words%')::INT) OVER (PARTITION BY key, caption ORDER BY y1 DESC, line) AS stopped FROM b) SELECT key, caption, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s WHERE stopped = 0 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "separators": f"""WITH l AS (SELECT k AS key, max(q) * 4 + 20 AS hi, max(q) * 2 - 10 AS lo FROM {MARKS} GROUP BY 1), i AS (SELECT l.*, greatest(lo, q * 4) AS a, least(hi, q * 4 + a / 4) AS b FROM l JOIN {MARKS} ON k = key WHERE q * 4 + a / 4 > lo AND q * 4 < hi UNION ALL SELECT *, lo, lo FROM l),
 g AS (SELECT *, coalesce(min(a) OVER (PARTITION BY key ORDER BY b DESC, a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi) AS cur FROM i), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cur - b DESC, cur DESC, b DESC) AS r FROM g) SELECT key, hi, lo, CASE WHEN cur > b THEN (cur + b) / 2 ELSE (hi + lo) / 2 END AS "at" FROM m WHERE r = 1""",
    "merged_rects": f"SELECT key, (row_number() OVER (PARTITION BY key ORDER BY y) - 1)::INT AS rect, x0, y - 0.96 AS y0, x1, y + 8.96 AS y1 FROM (SELECT key, y0 AS y, min(x0) AS x0, max(x1) AS x1 FROM {_plain(*CHARS)} GROUP BY 1, 2)",
    "selected_text": f"SELECT key, string_agg(ch, '' ORDER BY seq) AS text FROM {_SELECTED} GROUP BY 1",
    "selected_rects": f"SELECT key, (row_number() OVER (PARTITION BY key ORDER BY y) - 1)::INT AS rect, x0, y - 0.96 AS y0, x1, y + 8.96 AS y1 FROM (SELECT key, y0 AS y, min(x0) AS x0, max(x1) AS x1 FROM {_SELECTED} GROUP BY 1, 2)",
    "flow_order": f"""WITH l AS (SELECT * FROM {_plain(*LINE)}), r AS (SELECT * FROM {_plain(*REGION)} WHERE region <= 3), o AS (SELECT l.key, l.line, coalesce(min(r.region) FILTER (l.line = caption_line), min(r.region)) AS region
 FROM l LEFT JOIN r ON r.key = l.key AND (l.line = caption_line OR ((l.x0 + l.x1) / 2 BETWEEN r.x0 - 1 AND r.x1 + 1 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 1 AND r.y1 + 1)) GROUP BY 1, 2),
 p AS (SELECT key, coalesce((SELECT min(line) FROM o WHERE o.key = r.key AND o.region = r.region), (SELECT min(line) FROM l WHERE l.key = r.key AND (l.y0 + l.y1) / 2 < r.y0), (SELECT max(line) + 1 FROM l WHERE l.key = r.key)) AS pos, 0 AS t, region AS id, 'region' AS kind FROM r UNION ALL SELECT key, line, 1, line, 'line' FROM o WHERE region IS NULL)
 SELECT key, (row_number() OVER (PARTITION BY key ORDER BY pos, t, id) - 1)::INT AS seq, kind, id FROM p""",
    "column_gaps": f"""WITH m AS (SELECT k AS key, q::INT % 3 AS row, a * 2 AS x0 FROM {MARKS}), d AS (SELECT key, row FROM m GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT key, ceil(count(*) * 0.6) AS need FROM d GROUP BY 1),
 v AS (SELECT d.key, x, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.key = d.key AND m.row = d.row AND x BETWEEN x0 AND x0 + 10) AND EXISTS (SELECT 1 FROM m WHERE m.key = d.key AND m.row = d.row AND x0 > x)) AS votes FROM d, range(101) t(x) GROUP BY 1, 2),
 i AS (SELECT key, x, x - row_number() OVER (PARTITION BY key ORDER BY x) AS g FROM v JOIN w USING (key) WHERE votes >= need) SELECT key, min(x)::DOUBLE AS start, max(x)::DOUBLE AS \"end\" FROM i GROUP BY key, g""",
    "union_boxes": f"SELECT k AS key, min(a) AS x0, min(q * 3) AS y0, max(a + b / 3) AS x1, max(q * 3 + a / 2) AS y1 FROM {MARKS} GROUP BY 1",
    "upright_glyphs": f"SELECT k, n FROM {MARKS} WHERE a / 10 - 0.2 < 0 OR abs(sin(a / 10 - 0.2)) < 0.35",
    "margin_lines": f"SELECT k AS key, n AS line FROM {MARKS} WHERE q * 4 >= 147.2 OR q * 4 + 6 <= 12.8",
    "recognised_words": f"""SELECT k AS key, concat(f, n) AS word, round(10 + a * 10 * sx, 6) AS x0, round(812 - (q * 20 + a) * sx, 6) AS y0, round(10 + a * 10 * sx + b * sx, 6) AS x1, round(812 - (q * 20 + a) * sx + a * sx, 6) AS y1 FROM (SELECT *, 612.0::DOUBLE / 2550 AS sx FROM {MARKS}) WHERE f <> 'A' AND b >= 40 AND a > 0""",
    "pixel_sizes": f"""SELECT k, n, greatest(1, floor(a * 40 * (300.0::DOUBLE / 72) * z + 0.5))::INT AS width, greatest(1, floor(b * 30 * (300.0::DOUBLE / 72) * z + 0.5))::INT AS height FROM (SELECT *, CASE WHEN m > 4200 THEN 4200 / m ELSE 1 END AS z FROM (SELECT *, greatest(a * 40 * (300.0::DOUBLE / 72), b * 30 * (300.0::DOUBLE / 72)) AS m FROM {MARKS}))""",
    "measure_ends": f"""SELECT k, n, e::INT AS "end", (CASE e WHEN 0 THEN a ELSE b END)::DOUBLE AS x0, q - 4 * s AS y0, (CASE e WHEN 0 THEN a ELSE b END)::DOUBLE AS x1, q + 4 * s AS y1 FROM (SELECT *, CASE WHEN b > a THEN 1 ELSE -1 END AS s FROM {MARKS} WHERE f <> 'A' AND abs(b - a) >= 1e-9), range(2) t(e)""",
    "measure_boxes": f"""SELECT k AS key, n AS id, least(a - 5.5, a - (a + b / 3) / 2 - 2) AS x0, least(q * 3 - 5.5, q * 3 + a / 2 - 6.5) AS y0, greatest(a + b / 3 + 5.5, a + (a + b / 3) / 2 + 2) AS x1, q * 3 + a / 2 + 6.5 AS y1 FROM {MARKS}""",
    "contents_pages": f"""SELECT * FROM (SELECT doc_id, page_no, count(*) AS n_lines, count(*) FILTER (regexp_matches(t, '{ln.LEADER}')) AS leaders, count(*) FILTER (regexp_matches(t, '{ln.ENTRY}')) AS entries FROM (SELECT doc_id, page_no, {NORM.format('text')} AS t FROM {DOC_LINES}) WHERE t <> '' GROUP BY 1, 2) WHERE leaders >= 5 OR (entries >= 5 AND entries >= n_lines * 0.4)""",
    "suspect_pages": f"SELECT doc_id, 0 AS page_no, len(regexp_extract_all(t, '[{gr.UNMAPPED}]'))::INT AS unmapped, len(regexp_extract_all(t, '[^{gr.UNMAPPED}{gr.EXPECTED}]'))::INT AS unexpected FROM (SELECT doc_id, {ODD} AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '[{gr.UNMAPPED}]|[^{gr.UNMAPPED}{gr.EXPECTED}]')",
    "section_counts": f"SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN count(DISTINCT page_no % 3) ELSE 1 END)::BIGINT AS sections FROM {DOC_LINES} GROUP BY 1",
    "export_summary": f"""SELECT doc_id, count(*) AS chunks, sum(token_estimate)::BIGINT AS tokens, count(*) FILTER (quality = 'suspect') AS suspect, count(*) FILTER (quality = 'check') AS "check", coalesce(array_to_string(list_sort(list(DISTINCT page_no) FILTER (quality = 'suspect'))[1:12], ','), '') AS suspect_pages FROM {_plain(*CHUNKS)} GROUP BY 1""",
    "html_counters": f"""SELECT k AS doc_id, count(*) FILTER (n = 1) AS headings, count(*) FILTER (n > 5) AS paragraphs, count(*) FILTER (n = 4) AS equations, count(*) FILTER (n = 2) AS tables, count(*) FILTER (n = 3) AS figures, count(*) FILTER (n = 5) AS images, count(*) FILTER (f = 'R') AS suspect, count(*) FILTER (b > 45) AS clipped FROM {MARKS} GROUP BY 1""",
    "equation_quality": f"SELECT k, n, CASE f WHEN 'R' THEN 'suspect' ELSE 'check' END AS quality FROM {MARKS}",
    "chunk_equations": f"SELECT c.k AS doc_id, c.n AS chunk_index, string_agg(DISTINCT concat('(', e.b::INT % 3, ')'), ',') AS equations FROM {MARKS} c JOIN {MARKS} e ON e.k = c.k AND e.n BETWEEN c.n AND c.n + 1 AND e.b::INT % 3 = c.q::INT % 3 GROUP BY 1, 2",
    "valid_hits": f"SELECT k AS doc_id, n AS page_no, q::INT - 3 AS char_start, a::INT % 5 AS length FROM {MARKS} WHERE q >= 3 AND a::INT % 5 > 0 AND q::INT - 3 + a::INT % 5 <= b",
    "same_texts": f"SELECT first, doc_id AS copy FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower({NORM.format('text')}), doc_id % 2) AS first FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE doc_id <> first",
    "suggested_titles": f"""WITH t AS (SELECT doc_id, line_no, {NORM.format('text')} AS t FROM {DOC_LINES} WHERE page_no = 0 AND doc_id % 3 > 0), e AS (SELECT doc_id, line_no, CASE WHEN length(t) > 110 THEN substr(t, 1, 110) || '…' ELSE t END AS t FROM t), l AS (SELECT doc_id, arg_min(t, line_no) AS t FROM e WHERE length(t) BETWEEN 3 AND 110 AND regexp_matches(t, '\\p{{L}}') GROUP BY 1)
 SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN concat('Outline of ', source) ELSE coalesce(t, concat(lang, ' ', replace(replace(source, '_', ' '), '-', ' '), ' ', doc_id)) END AS title FROM documents LEFT JOIN l USING (doc_id)""",
    "inserted_pages": f"""WITH p AS {_NUMBERED} SELECT book, doc_id, (page_no + CASE WHEN page_no >= 3 AND book % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS page_no FROM p UNION ALL SELECT book, doc_id, (page_no + least(3, c))::BIGINT FROM p JOIN (SELECT book, count(*) AS c FROM p GROUP BY 1) USING (book) WHERE page_no < 2 AND book % 2 = 0""",
    "merged_pages": f"SELECT book AS file, doc_id, (row_number() OVER (ORDER BY book DESC, page_no) - 1)::BIGINT AS page_no FROM {_NUMBERED}",
    "extracted_pages": f"SELECT book, doc_id, (row_number() OVER (PARTITION BY book ORDER BY page_no) - 1)::INT AS page_no FROM {_NUMBERED} WHERE doc_id % 3 = 0",
    "moved_files": f"SELECT book AS set_id, doc_id AS file, (CASE WHEN count(*) OVER (PARTITION BY book) <= 4 THEN page_no WHEN page_no = 1 THEN 4 WHEN page_no BETWEEN 2 AND 4 THEN page_no - 1 ELSE page_no END)::INT AS ord FROM {_NUMBERED}",
    "pending_files": "SELECT doc_id AS path, md5(text) AS hash FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0 AND text IS NOT NULL)",
    "printed_headings": f"""SELECT k, n, CASE c WHEN 0 THEN concat('6.4.', n, ' Punching shear') WHEN 1 THEN concat('1.', n, ' Gk') WHEN 2 THEN concat('6.', n, '. General') WHEN 5 THEN concat('Figure 2.', n, ' Stress') END AS printed, c IN (0, 2) AS alone, c = 5 AS caption, c IN (0, 1, 2, 3, 5) AS beside FROM (SELECT *, b::INT % 6 AS c FROM {MARKS})""",
    "read_files": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 > 1 THEN length(text) END AS n_chars, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'not UTF-8' END AS error FROM documents",
}
_M = f"WITH p AS (SELECT doc_id, page_no, line_no AS seq, lower({NORM.format('text')}) AS t FROM {DOC_LINES}), m AS (SELECT doc_id, page_no, line_no AS ord, CASE WHEN line_no % 4 = 0 THEN lower(substr({NORM.format('substr(text, 1, 60)')}, 1, 40)) ELSE concat('none ', line_no) END AS h FROM {DOC_LINES} WHERE line_no % 2 = 0), x AS (SELECT m.doc_id, m.page_no, m.ord, min(p.seq) AS seq FROM m LEFT JOIN p ON p.doc_id = m.doc_id AND p.page_no = m.page_no AND h <> '' AND starts_with(t, h) GROUP BY 1, 2, 3)"
ORACLES["marker_paragraphs"] = f"{_M} SELECT * FROM x"
ORACLES["live_markers"] = f"{_M} SELECT doc_id, page_no, ord FROM (SELECT *, coalesce(max(CASE WHEN seq IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id, page_no), -1) AS last FROM x) WHERE seq IS NULL AND ord > last"

# Boxes grow step by step; the last step of a caption and side has them all.
ORACLES["caption_regions"] = f"""WITH RECURSIVE c AS (SELECT key, line AS caption, CASE WHEN line % 2 = 0 THEN 'Table' ELSE 'Figure' END AS kind, y0, y1 FROM {_plain(*LINE)} WHERE text LIKE 'Table%'),
 m AS (SELECT c.key, c.caption, c.kind, c.y0, c.y1, coalesce(max(o.y1) FILTER (o.y1 < c.y0), 0) AS low, coalesce(min(o.y0) FILTER (o.y0 > c.y1), 220) AS high FROM c JOIN c o ON o.key = c.key GROUP BY ALL),
 g AS (SELECT m.key, caption, kind, 'below' AS side, x0, b.y0, x1, b.y1, b.y1 >= m.y0 - 45 AS seed FROM m JOIN {_plain(*BOX)} b ON b.key = m.key WHERE b.y1 <= m.y0 + 2 AND b.y0 >= low - 1
  UNION ALL SELECT m.key, caption, kind, 'above', x0, b.y0, x1, b.y1, b.y0 <= m.y1 + 45 FROM m JOIN {_plain(*BOX)} b ON b.key = m.key WHERE b.y0 >= m.y1 - 2 AND b.y1 <= high + 1),
 t AS (SELECT key, caption, kind, side, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g WHERE seed GROUP BY 1, 2, 3, 4
  UNION SELECT t.key, t.caption, t.kind, t.side, least(t.x0, min(g.x0)), least(t.y0, min(g.y0)), greatest(t.x1, max(g.x1)), greatest(t.y1, max(g.y1)) FROM t JOIN g ON g.key = t.key AND g.caption = t.caption AND g.side = t.side
   AND g.x0 <= t.x1 + 4 AND g.x1 >= t.x0 - 4 AND g.y0 <= t.y1 + 4 AND g.y1 >= t.y0 - 4 GROUP BY t.key, t.caption, t.kind, t.side, t.x0, t.y0, t.x1, t.y1),
 f AS (SELECT key, caption, kind, side, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY 1, 2, 3, 4)
 SELECT key, caption, side, x0, y0, x1, y1 FROM f WHERE x1 - x0 >= 20 AND y1 - y0 >= 8 QUALIFY row_number() OVER (PARTITION BY key, caption ORDER BY (kind = 'Table') = (side = 'below') DESC) = 1"""
ORACLES["display_blocks"] = f"""WITH l AS (SELECT * FROM {_plain(*MARGINED)}), b AS (SELECT * FROM {_plain(*BOX)} WHERE id % 4 = 1),
 e AS (SELECT *, lag(cy) OVER w AS before, lead(cy) OVER w AS after FROM (SELECT *, (ly0 + ly1) / 2 AS cy, greatest(4, ly1 - ly0) AS h FROM {_plain(*EQUATION)} WHERE eq % 3 = 0) WINDOW w AS (PARTITION BY key ORDER BY cy DESC, eq)),
 t AS (SELECT * FROM l WHERE x1 > x0 AND text <> '' AND (margin OR regexp_matches(text, '{ln.FORMULA_NEIGHBOUR}') OR regexp_matches(text, '{ln.REGION_CAPTION}') OR len(regexp_extract_all(text, '{ln.PROSE_WORD}')) >= 2)),
 i AS (SELECT key, y0, y1 FROM l WHERE x1 > x0 AND NOT margin UNION ALL SELECT key, y0, y1 FROM b), p AS (SELECT DISTINCT key, cy AS hi, after AS lo FROM e WHERE after IS NOT NULL),
 x AS (SELECT p.*, greatest(lo, y0) AS a, least(hi, y1) AS z FROM p JOIN i ON i.key = p.key AND y1 > lo AND y0 < hi UNION ALL SELECT *, lo, lo FROM p),
 g AS (SELECT *, coalesce(min(a) OVER (PARTITION BY key, hi, lo ORDER BY z DESC, a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi) AS cursor FROM x),
 s AS (SELECT key, hi, lo, CASE WHEN cursor > z THEN (cursor + z) / 2 ELSE (hi + lo) / 2 END AS at FROM g QUALIFY row_number() OVER (PARTITION BY key, hi, lo ORDER BY cursor - z DESC, cursor DESC, z DESC) = 1),
 c AS (SELECT key, list_sort(list(x0))[floor(count(*) * 0.1)::INT + 1] AS lft, list_sort(list(x1))[least(count(*) - 1, floor(count(*) * 0.9))::INT + 1] AS rgt FROM l WHERE NOT margin AND x1 - x0 > y1 - y0 AND length(text) >= 15 GROUP BY 1),
 r AS (SELECT e.*, coalesce(lft, 50) AS lft, coalesce(rgt, 70) AS rgt, u.at AS cut_up, d.at AS cut_down, (SELECT min(y0) FROM t WHERE t.key = e.key AND t.y0 >= ly1 + h / 4) AS over, (SELECT max(y1) FROM t WHERE t.key = e.key AND t.y1 <= ly0 - h / 4) AS under
  FROM e LEFT JOIN c ON c.key = e.key LEFT JOIN s u ON u.key = e.key AND u.hi = before AND u.lo = cy LEFT JOIN s d ON d.key = e.key AND d.hi = cy AND d.lo = after)
 SELECT key, eq, least(lft, x0)::DOUBLE AS x0, least(y0, greatest(cy - 100, 230 * 0.08, coalesce(under + 1.5, -1e9), coalesce(cut_down, -1e9)))::DOUBLE AS y0, greatest(rgt, x1)::DOUBLE AS x1,
  greatest(y1, least(cy + 100, 230 * 0.92, coalesce(over - 1.5, 1e9), coalesce(cut_up, 1e9)))::DOUBLE AS y1 FROM r"""
