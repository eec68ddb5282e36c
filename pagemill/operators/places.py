"""Lengths in units, snapping of points, overlapping boxes, and page texts as HTML or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import crossing
from ..functions.text import ellipsize, margin_key, normalise
from ..sources.tables import csv_cell, tsv_cell

# Millimetres in a unit.
MILLIMETRES = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "km": 1000000.0, "in": 25.4, "ft": 304.8, "pt": 25.4 / 72}


def in_unit(points: Column, ratio: Column, unit: Column) -> Column:
    """A length on the page in the unit, at a scale of 1 to ``ratio``; NaN for an unknown unit."""
    known = F.create_map(*[F.lit(x) for pair in MILLIMETRES.items() for x in pair])
    return F.coalesce(points * MILLIMETRES["pt"] * ratio / F.try_element_at(known, unit), F.lit(float("nan")))


def scale_of(text: Column) -> Column:
    """"1:50" or "50" -> 50; null unless a positive finite number."""
    n = F.regexp_replace(F.trim(text), "^1 *: *", "").try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def _cells(lo: Column, hi: Column, tolerance: float, side: float) -> Column:
    return F.sequence(F.floor((lo - tolerance) / side), F.floor((hi + tolerance) / side))


#: Segments of a page that are compared directly; pages of more are cut into cells.
FEW = 64


def _counted(segments: DataFrame) -> DataFrame:
    """The segments with ``few``: whether their page has few."""
    n = segments.groupBy("key").agg((F.count(F.lit(1)) <= FEW).alias("few"))
    return segments.join(n, "key")


def _unless_few(cells: Column) -> Column:
    return F.when(F.col("few"), F.array(F.lit(0).cast("bigint"))).otherwise(cells)


def _listed(segments: DataFrame, tolerance: float, side: float) -> DataFrame:
    """Counted segments in the cells that they pass within the tolerance: of each column, those of the part of the line in it."""
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    across = segments.withColumn("cx", F.explode(_unless_few(_cells(left, right, tolerance, side))))
    slope = F.when(left < right, (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))

    def at(x: Column) -> Column:
        return F.col("y0") + (x - F.col("x0")) * slope

    a, b = at(F.greatest(left, F.col("cx") * side - tolerance)), at(F.least(right, (F.col("cx") + 1) * side + tolerance))
    low = F.greatest(F.least("y0", "y1"), F.coalesce(F.least(a, b), F.least("y0", "y1")))
    high = F.least(F.greatest("y0", "y1"), F.coalesce(F.greatest(a, b), F.greatest("y0", "y1")))
    return across.withColumn("cy", F.explode(_unless_few(_cells(low, F.greatest(low, high), tolerance * (1 + 1e-6), side))))


def _crossings(segments: DataFrame, side: float) -> DataFrame:
    listed = _listed(segments, side / 8, side).select("key", "few", "cx", "cy", "sid", F.struct("x0", "y0", "x1", "y1").alias("s"))
    other = listed.select("key", "cx", "cy", F.col("sid").alias("sid2"), F.col("s").alias("s2"))
    met = listed.join(other, ["key", "cx", "cy"]).where("sid < sid2").withColumn("p", crossing("s", "s2")).where("p is not null")
    own = F.col("few") | ((F.floor(F.col("p.x") / side) == F.col("cx")) & (F.floor(F.col("p.y") / side) == F.col("cy")))
    return met.where(own).select("key", "few", "sid", "sid2", "p.x", "p.y")


def crossings(segments: DataFrame, side: float) -> DataFrame:
    """Where two segments ``(key, sid, x0, y0, x1, y1)`` of a key cross.

    Segments meet in cells of width ``side``; a crossing counts only in its own cell, so none comes twice. Of keys with few
    segments each meets each.
    """
    return _crossings(_counted(segments), side).drop("few")


def snap(points: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """``(key, pid, x, y)`` to the best place of ``(key, sid, x0, y0, x1, y1)`` within the tolerance.

    End points (kind 0) come before crossings (1), these before midpoints (2) and the nearest
    place on a line (3), even where farther. Segments are listed in the cells of their box,
    widened by the tolerance; cells are eight tolerances wide, so a point meets only its own
    cell's segments.
    """
    side = 8 * tolerance
    segments = _counted(segments)
    cell = lambda c: F.when(F.col("few"), F.lit(0).cast("bigint")).otherwise(F.floor(F.col(c) / side))
    at = points.join(segments.select("key", "few").distinct(), "key").withColumns({"cx": cell("x"), "cy": cell("y")}).drop("few")
    near = at.join(_listed(segments, tolerance, side), ["key", "cx", "cy"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / square)))
    places = [(0, F.col("x0"), F.col("y0")), (0, F.col("x1"), F.col("y1")), (2, F.col("x0") + dx / 2, F.col("y0") + dy / 2), (3, F.col("x0") + t * dx, F.col("y0") + t * dy)]

    def place(kind: int, px: Column, py: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.sqrt((px - F.col("x")) ** 2 + (py - F.col("y")) ** 2).alias("distance"), px.alias("sx"), py.alias("sy"))

    spots = _crossings(segments, side).select("key", "few", F.col("x").alias("px"), F.col("y").alias("py"))
    spots = spots.withColumn("cx", F.explode(_unless_few(_cells(F.col("px"), F.col("px"), tolerance, side)))).withColumn("cy", F.explode(_unless_few(_cells(F.col("py"), F.col("py"), tolerance, side))))
    crossed = at.join(spots, ["key", "cx", "cy"]).select("key", "pid", place(1, F.col("px"), F.col("py")).alias("p"))
    each = near.select("key", "pid", F.explode(F.array(*[place(*p) for p in places])).alias("p")).unionByName(crossed).where(F.col("p.distance") <= tolerance)
    best = each.groupBy("key", "pid").agg(F.min("p").alias("p"))
    return best.select("key", "pid", "p.kind", "p.distance", "p.sx", "p.sy")


def without_overlap(boxes: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Boxes ``(x0, y0, x1, y1)`` that no other box of their key overlaps."""
    o = others.select(F.col(key).alias("_k"), *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")])
    return boxes.join(o, (F.col(key) == F.col("_k")) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1")), "left_anti")


def watermarks(pages: DataFrame, share: float = 0.8, least: int = 3, shortest: int = 4, group: str = "book") -> DataFrame:
    """Lines on so large a share of all of a book's pages, blank ones counted; the label is the first sample."""
    of = pages.groupBy(group).agg(F.count(F.lit(1)).alias("n_pages"))
    line = pages.select(group, "page_no", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).withColumn("line", normalise(F.col("raw"))).where(F.length("line") >= shortest)
    seen = line.groupBy(group, "line").agg(F.countDistinct("page_no").alias("on_pages"), F.min_by(normalise(F.col("raw")), F.struct("page_no", "at")).alias("sample")).where(F.col("on_pages") >= least)
    return seen.join(of, group).where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))).select(group, "line", "on_pages", ellipsize(F.col("sample")).alias("label"))


def strip_lines(pages: DataFrame, marks: DataFrame, group: str = "book") -> DataFrame:
    """The pages without the marked lines; a line that only quotes part of a mark stays."""
    line = pages.select(group, "page_no", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).withColumn("line", normalise(F.col("raw")))
    left = line.join(marks.select(group, "line").distinct(), [group, "line"], "left_anti")
    body = left.groupBy(group, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    return pages.select(group, "page_no").join(body, [group, "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def running_titles(pages: DataFrame, share: float = 0.3, least: int = 3, group: str = "book") -> DataFrame:
    """A book's most frequent first line, page numbers apart; its text is the last one seen, without the number."""
    of = pages.where(normalise(F.col("text")) != "").groupBy(group).agg(F.count(F.lit(1)).alias("n_pages"))
    top = pages.select(group, "page_no", normalise(F.element_at(F.split("text", "\n", -1), 1)).alias("line")).where("line <> ''")
    seen = top.groupBy(group, margin_key(F.col("line")).alias("line_key")).agg(F.count(F.lit(1)).alias("on_pages"), F.max_by("line", "page_no").alias("last"))
    kept = seen.join(of, group).where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share)))
    first = kept.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.desc("on_pages"), "line_key"))).where("_n = 1")
    return first.select(group, F.regexp_replace("last", "^[0-9]+ +| +[0-9]+$", "").alias("title"), "on_pages")


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_html(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, page_no, ord, depth, text)`` -> one HTML text a document; depth 0 is body text, others headings."""
    level = F.least(F.greatest(F.col("depth") + 1, F.lit(2)), F.lit(6)).cast("string")
    tag = F.when(F.col("depth") == 0, "p").otherwise(F.concat(F.lit("h"), level))
    html = F.concat(F.lit("<"), tag, F.lit(">"), escape(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    return paragraphs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "ord", html.alias("h")))), lambda x: x["h"]), "\n").alias("html"))


def grid_text(cells: DataFrame, kind: str = "csv") -> DataFrame:
    """Cells ``(key, row, col, text)`` as one table text a key; empty cells between are kept."""
    cell, sep, end = (csv_cell, ",", "\r\n") if kind == "csv" else (tsv_cell, "\t", "\n")
    wide = cells.withColumn("_w", F.max("col").over(W.partitionBy("key")))
    rows = wide.groupBy("key", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", cell(F.coalesce("text", F.lit(""))).alias("t")))).alias("m"), F.first("_w").alias("w"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("w").cast("bigint")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), sep)
    lines = rows.select("key", "row", line.alias("l"))
    return lines.groupBy("key").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "l"))), lambda x: x["l"]), end), F.lit(end)).alias("content"))
