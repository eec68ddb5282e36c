"""Documents as HTML: headings with anchors, a list of contents, page anchors, notes, grades and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.grades import grade
from ..functions.text import heading_depth
from .places import escape

NOTE = r"^NOTE\b"
ANNEX_HEADING = r"^Annex\s+([A-Z]{1,2})\b"


def heading_number(text: Column) -> Column:
    """"6.4" of "6.4 Loads", "B" of "Annex B"; empty if the heading has no number."""
    body = F.regexp_extract(text, ln.BODY_HEADING, 1)
    return F.when(body != "", body).otherwise(F.regexp_extract(text, ANNEX_HEADING, 1))


def heading_level(text: Column) -> Column:
    """The HTML level, from 2 to 6: one deeper than the number says; headings without one, and annexes, have 2."""
    body = F.regexp_extract(text, ln.BODY_HEADING, 1)
    return F.when(body == "", 2).otherwise(F.least(heading_depth(body) + 1, F.lit(6)))


def anchored(rows: DataFrame, key: str, base: str) -> DataFrame:
    """``id``: the anchor made of ``base``, with -2, -3 and so on where the document has it before in (page_no, ord)."""
    plain = F.btrim(F.regexp_replace(base, r"[^A-Za-z0-9.\-]+", "-"), F.lit("-"))
    rows = rows.withColumn("id", F.when(plain == "", "x").otherwise(plain))
    n = F.row_number().over(W.partitionBy(key, "id").orderBy("page_no", "ord"))
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.concat_ws("-", "id", "_n"))).drop("_n")


def html_bodies(items: DataFrame, regions: DataFrame | None = None, labels: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, page_no, ord, text, is_heading, issues)`` in reading order, ``regions`` (key, page_no, ord, kind, label,
    caption, text) among them by ``ord``, and printed page ``labels`` (key, page_no, label) -> ``(key, contents, body)``.

    Each page begins with its anchor. Headings and regions have anchors of their own, and headings stand in the list of
    contents. Paragraphs that begin with NOTE, and those graded suspect or to be checked, carry it as a class. Blank
    texts are left out; null issues are none. Only headings and regions are ordered for their anchors; a document's
    pieces meet in one row, as they do in its file.
    """
    own = items.where(F.trim("text") != "").select(key, "page_no", "ord", "text", F.coalesce("is_heading", F.lit(False)).alias("is_heading"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    page = (F.col("page_no") + 1).cast("string")
    text = escape(F.col("text"))
    piece = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit(None).cast("string")

    number = heading_number(F.col("text"))
    heads = own.where("is_heading").withColumn("_b", F.concat(F.lit("sec-"), F.when(number != "", number).otherwise(F.substring("text", 1, 40))))
    heads = heads.select(key, "page_no", "ord", "text", F.lit("h").alias("_k"), "_b", none.alias("label"), none.alias("caption"))
    if regions is not None:
        shown = regions.withColumn("_b", F.when(F.col("kind") == "equation", F.concat(F.lit("eq-"), F.btrim("label", F.lit("()")))).otherwise(F.lower("label")))
        heads = heads.unionByName(shown.select(key, "page_no", "ord", F.coalesce("text", F.lit("")).alias("text"), F.col("kind").alias("_k"), "_b", "label", "caption"))
    heads = anchored(heads, key, "_b")
    level = heading_level(F.col("text")).cast("string")
    layer = F.when(F.col("text") == "", "").otherwise(piece('<details class="text-layer"><summary>Text layer</summary><pre>', text, "</pre></details>\n"))
    figure = piece('<figure class="', F.col("_k"), '" id="', F.col("id"), '" data-label="', escape(F.col("label")), '" data-page="', page, '">\n<figcaption>', escape(F.coalesce("caption", "label")), "</figcaption>\n", layer, "</figure>")
    title = piece("<h", level, ' id="', F.col("id"), '" data-page="', page, '">', text, "</h", level, ">")
    entry = F.when(F.col("_k") == "h", piece('<li class="l', level, '"><a href="#', F.col("id"), '">', text, "</a></li>"))
    heads = heads.select(key, "page_no", "ord", F.when(F.col("_k") == "h", title).otherwise(figure).alias("html"), entry.alias("entry"))

    quality = grade(F.col("issues"), F.col("text"))
    classes = F.concat_ws(" ", F.when(F.col("text").rlike(NOTE), "note"), F.when(quality != "ok", quality))
    opened = piece("<p", F.when(classes == "", "").otherwise(piece(' class="', classes, '"')), F.when(F.size("issues") > 0, piece(' title="', escape(F.array_join("issues", "; ")), '"')).otherwise(""), ">")
    paragraphs = own.where("not is_heading").select(key, "page_no", "ord", piece(opened, text, "</p>").alias("html"), none.alias("entry"))

    rows = heads.unionByName(paragraphs)
    pages = rows.select(key, "page_no").distinct()
    label = page
    if labels is not None:
        pages = pages.join(labels.groupBy(key, "page_no").agg(F.min("label").alias("label")), [key, "page_no"], "left")
        label = escape(F.coalesce("label", page))
    begin = piece('<div class="page" id="page-', page, '" data-page="', page, '"><span>p. ', label, "</span></div>")
    first = pages.select(key, "page_no", F.lit(None).cast(items.schema["ord"].dataType).alias("ord"), begin.alias("html"), none.alias("entry"))
    # Nulls come first: a page's anchor stands before its pieces.
    all_ = rows.unionByName(first).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", F.col("ord").isNotNull().alias("_i"), "ord", "html", "entry"))).alias("all"))
    entries = F.filter(F.transform("all", lambda x: x["entry"]), lambda e: e.isNotNull())
    return all_.select(key, F.array_join(entries, "\n").alias("contents"), F.array_join(F.transform("all", lambda x: x["html"]), "\n").alias("body"))


def html_file(title: Column, contents: Column, body: Column) -> Column:
    """The whole text of a document's HTML file; one without headings has no list of contents."""
    t = escape(F.coalesce(title, F.lit("")))
    nav = F.when(contents == "", "").otherwise(F.concat(F.lit("<nav><details><summary>Contents</summary><ul>\n"), contents, F.lit("\n</ul></details></nav>\n")))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), t, F.lit("</title>\n</head>\n<body>\n<header><h1>"), t, F.lit("</h1></header>\n"))
    return F.concat(head, nav, F.lit("<main>\n"), body, F.lit("\n</main>\n</body>\n</html>\n"))
