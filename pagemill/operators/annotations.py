"""Scans of a document's own tables: metadata, page labels and sizes, outlines, annotations, shapes and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import without_overlap

# Fields of the metadata; names of annotation kinds as users see them; which are stamps, lines and measures.
METADATA = ("title", "author", "subject", "keywords", "creator", "producer", "created", "modified")
KIND_LABELS = {
    "Highlight": "Highlight", "Comment": "Note", "Ink": "Freehand drawing", "Cloud": "Revision cloud", "TextBox": "Text box", "Callout": "Callout", "Image": "Image", "Rectangle": "Rectangle",
    "Ellipse": "Ellipse", "Line": "Line", "Arrow": "Arrow", "Tick": "Tick", "MeasureDistance": "Distance", "MeasurePerimeter": "Perimeter", "MeasureArea": "Area",
}
OTHER_KIND = "Annotation"
STAMP_KINDS = tuple(k for k in KIND_LABELS if k not in ("Highlight", "Comment", "Ink"))
LEAST_POINTS = {"Line": 1, "Arrow": 1, "MeasureDistance": 2, "MeasurePerimeter": 2, "MeasureArea": 3}
OUTLINE_NODES, OUTLINE_DEPTH = 8_000, 32
SHAPE = "Kind string, Box array<double>, Leader array<array<double>>, Upp double, Unit string, Dec int, LineWidth double"


def metadata(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The eight fields of each document; what is absent is an empty text."""
    return rows.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in METADATA])


def page_label(label: Column, page_no: Column) -> Column:
    """A page's printed label; null where blank, or where it says no more than the page's number."""
    return F.when((F.trim(label) != "") & (label != (page_no + 1).cast("string")), label)


def page_box(media: Column, crop: Column) -> Column:
    """Of boxes ``(l, b, r, t)``: the crop clamped to the media box, or the media box where nothing is left, as origin and size."""
    cut = F.struct(F.greatest(crop["l"], media["l"]).alias("l"), F.greatest(crop["b"], media["b"]).alias("b"), F.least(crop["r"], media["r"]).alias("r"), F.least(crop["t"], media["t"]).alias("t"))
    fits = crop["l"].isNotNull() & (cut["r"] > cut["l"]) & (cut["t"] > cut["b"])
    own = F.when(fits, cut).otherwise(F.struct(*[media[c].alias(c) for c in "lbrt"]))
    return F.struct(own["l"].alias("x"), own["b"].alias("y"), (own["r"] - own["l"]).alias("width"), (own["t"] - own["b"]).alias("height"))


def outline(nodes: DataFrame) -> DataFrame:
    """Entries ``(doc_id, node, ord, depth, title, page_no)``: each node once, to a depth of 32 and 8,000 a document."""
    once = nodes.groupBy("doc_id", "node").agg(F.min(F.struct("ord", "depth", "title", "page_no")).alias("e")).select("doc_id", "node", "e.*")
    near = once.where(F.col("depth") < OUTLINE_DEPTH)
    return near.withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("ord", "node")) - 1).where(F.col("at") < OUTLINE_NODES)


def kind_label(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_KIND))


def is_comment(kind: Column, text: Column, replies: Column) -> Column:
    """A note, or a highlight that says something or was replied to; everything else is markup."""
    return (kind == "Comment") | ((kind == "Highlight") & ((F.trim(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(replies, F.lit(0)) > 0)))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """``(doc_id, page_no, kind, text, n_replies)`` -> annotations, comments and replies of each page."""
    comment = is_comment(F.col("kind"), F.col("text"), F.col("n_replies"))
    return annotations.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("annotations"), F.count_if(comment).alias("comments"), F.coalesce(F.sum("n_replies"), F.lit(0)).alias("replies"))


def decode_shape(json: Column) -> Column:
    """A stamp's own JSON; null if it is no JSON, has no box of four, no stamp kind, or too few points for its kind."""
    s = F.from_json(json, SHAPE)
    points = F.filter(F.coalesce(s["Leader"], F.array().cast("array<array<double>>")), lambda p: F.size(p) == 2)
    least = F.create_map(*[F.lit(x) for pair in LEAST_POINTS.items() for x in pair])
    usable = (F.size(s["Box"]) == 4) & s["Kind"].isin(*STAMP_KINDS) & (F.size(points) >= F.coalesce(F.try_element_at(least, s["Kind"]), F.lit(0)))
    scaled = s["Kind"].startswith("Measure") & (s["Upp"] > 0) & (s["Upp"] < float("inf")) & (F.trim(s["Unit"]) != "")
    return F.when(
        usable,
        F.struct(
            s["Kind"].alias("kind"), s["Box"].alias("box"), points.alias("points"),
            F.when(scaled, s["Upp"]).alias("units_per_point"), F.when(scaled, s["Unit"]).alias("unit"),
            F.when(scaled, F.greatest(F.lit(0), F.least(F.lit(6), F.coalesce(s["Dec"], F.lit(2))))).alias("decimals"),
            F.when(s["LineWidth"] > 0, s["LineWidth"]).otherwise(0.0).alias("line_width"),
        ),
    )


def is_kept_url(url: Column) -> Column:
    return (F.length(url) >= 4) & F.lower(url).rlike("^(?:http|mailto:|ftp)")


def page_overlay(annotated: DataFrame, found: DataFrame, references: DataFrame, key: str = "page") -> DataFrame:
    """A page's clickable boxes ``(key, id, x0, y0, x1, y1, target)`` in order: annotated links, addresses in the text that
    overlap none of them, then references. Boxes under a point in either direction and addresses of other kinds are left out."""
    big = (F.col("x1") - F.col("x0") >= 1) & (F.col("y1") - F.col("y0") >= 1)
    own = annotated.where(big)
    web = without_overlap(found.where(big & is_kept_url(F.col("target"))), own, key)
    kinds = [part.select(key, "id", "target", F.lit(k).alias("kind")) for k, part in enumerate((own, web, references.where(big)))]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return both.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("kind", "id")) - 1)


def image_watermarks(images: DataFrame, share: float = 0.88, least: int = 3) -> DataFrame:
    """Images ``(doc_id, page_no, bytes, width, height, page_width, page_height, has_body)`` that fill most of ``least`` pages or more; safe to remove if all these pages have other content."""
    large = (F.col("width") >= F.col("page_width") * share) & (F.col("height") >= F.col("page_height") * share)
    by = images.where(large).groupBy("doc_id", F.upper(F.sha2("bytes", 256)).alias("sha256"))
    return by.agg(F.countDistinct("page_no").alias("on_pages"), F.bool_and("has_body").alias("safe")).where(F.col("on_pages") >= least)


def ordered_watermarks(images: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, label, on_pages)`` of both kinds in the order they are offered: images, then by pages, then the longer label."""
    both = images.select("doc_id", "label", "on_pages", F.lit(0).alias("kind")).unionByName(texts.select("doc_id", "label", "on_pages", F.lit(1).alias("kind")))
    return both.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("kind", F.desc("on_pages"), F.desc(F.length("label")), "label")) - 1)
