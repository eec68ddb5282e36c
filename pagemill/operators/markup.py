"""Colours, credits and measurements of annotations; cells, scripts, sections and outline titles of texts; page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grades import EXPECTED, UNMAPPED
from ..sources.tables import csv_cell

# The palette, as 24-bit colours; signs that a spreadsheet takes for a formula.
PALETTE = {"Yellow": 0xFFEB3B, "Green": 0x81C784, "Blue": 0x64B5F6, "Pink": 0xF06292, "Orange": 0xFFB74D}
FORMULA = "^[=+\\-@\t\r]"
MEASUREMENTS = ("Page", "Type", "Value", "Unit", "Scale", "Points", "Author", "Created")
FRONT = "Front matter"


def pack_colour(red: Column, green: Column, blue: Column) -> Column:
    """An opaque colour of three channels, each taken modulo 256, as an unsigned number of 32 bits."""
    r, g, b = (F.pmod(c.cast("bigint"), F.lit(256)) for c in (red, green, blue))
    return F.lit(0xFF000000) + r * 65536 + g * 256 + b


def channels(colour: Column) -> list[Column]:
    return [F.pmod(F.floor(colour / d), F.lit(256)) for d in (65536, 256, 1)]


def exact_colour(colour: Column) -> Column:
    """The palette's name of a colour, whatever its opacity; else "Custom"."""
    names = F.create_map(*[F.lit(x) for name, c in PALETTE.items() for x in (c, name)])
    return F.coalesce(F.try_element_at(names, F.pmod(colour, F.lit(0x1000000)).cast("int")), F.lit("Custom"))


def nearest_colour(colour: Column) -> Column:
    """The palette's nearest colour; of equally near ones the first."""
    own = channels(colour)
    far = [sum((a - c // d % 256) ** 2 for a, d in zip(own, (65536, 256, 1), strict=True)) for c in PALETTE.values()]
    each = [F.struct(f.alias("far"), F.lit(n).alias("ord"), F.lit(name).alias("name")) for n, (name, f) in enumerate(zip(PALETTE, far, strict=True))]
    return F.array_min(F.array(*each))["name"]


def attribution(author: Column, created: Column, modified: Column) -> Column:
    """"author · date", or what there is of it."""
    return F.concat_ws(" · ", F.nullif(F.trim(author), F.lit("")), F.date_format(F.coalesce(created, modified), "yyyy-MM-dd"))


def image_bytes(text: Column) -> Column:
    """Base64 text -> bytes; null if it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def measurement_line(cells: list[Column]) -> Column:
    """A line of the measurements' table: formulas are disarmed, null cells empty."""

    def cell(c: Column) -> Column:
        t = F.coalesce(c.cast("string"), F.lit(""))
        return csv_cell(F.when(t.rlike(FORMULA), F.concat(F.lit("'"), t)).otherwise(t))

    return F.concat_ws(",", *[cell(c) for c in cells])


def merged_cells(row: Column) -> Column:
    """Cells that a column's edge cut through, joined again, with the columns they span.

    A cell goes on where the one before ends in a letter and it starts lower-case, or where that one ends in a slash.
    """
    zero = F.array().cast("array<struct<text: string, span: int>>")

    def step(kept: Column, raw: Column) -> Column:
        cell, last = F.trim(raw), F.try_element_at(kept, F.lit(-1))
        goes_on = (last["text"].rlike(r"\p{L}$") & cell.rlike(r"^\p{Ll}")) | (last["text"].rlike("/$") & (cell != ""))
        longer = F.struct(F.concat(last["text"], cell).alias("text"), (last["span"] + 1).alias("span"))
        fresh = F.struct(cell.alias("text"), F.lit(1).alias("span"))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(kept, F.array(fresh)))

    return F.aggregate(F.filter(row, lambda c: c.isNotNull()), zero, step)


def script_profile(pages: DataFrame, share: float = 0.2, group: str = "book") -> DataFrame:
    """Blocks of 128 code points that hold so large a share of a book's letters though not expected there.

    Only unexpected letters become rows.
    """
    odd = F.regexp_extract_all("text", F.lit(f"[\\p{{L}}&&[^{UNMAPPED}{EXPECTED}]]"), 0)
    each = pages.select(group, F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"), odd.alias("odd"))
    of = each.groupBy(group).agg(F.sum("letters").alias("letters"))
    blocks = each.select(group, F.explode("odd").alias("c")).groupBy(group, F.floor(F.ascii("c") / 128).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return blocks.join(of, group).where(F.col("n") >= F.col("letters") * share).select(group, "block", "n", "letters")


def sections_in_force(paragraphs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``(doc_id, page_no, seq, section)``, null where no section starts -> the section each paragraph stands in.

    ``marks`` ``(doc_id, page_no, ord, section)`` that no paragraph prints switch at the top of
    their page, the last one of a page winning.
    """
    rows = paragraphs.select("doc_id", "page_no", "seq", F.lit(0).alias("_m"), F.lit(0).alias("_o"), "section")
    if marks is not None:
        rows = rows.unionByName(marks.select("doc_id", "page_no", F.lit(-1).cast("int").alias("seq"), F.lit(1).alias("_m"), F.col("ord").alias("_o"), "section"))
    so_far = W.partitionBy("doc_id").orderBy("page_no", "seq", "_o").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(so_far), F.lit(FRONT))).where("_m = 0").select("doc_id", "page_no", "seq", "section")


def outline_titles(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """Headings ``(doc_id, number, title)`` with the outline's title of their number, the first of several, where it has one."""
    first = outline.groupBy("doc_id", "number").agg(F.min_by("title", "ord").alias("_t"))
    return headings.join(first, ["doc_id", "number"], "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def labels_on_pages(chunks: DataFrame, equations: DataFrame, key: str = "doc_id", ends: tuple[str, str] = ("page_start", "page_end")) -> DataFrame:
    """``(key, chunk_index, labels)``: the ``equations`` (key, page_no, label) on the pages of each chunk that has any, as
    (page_no, label) in order."""
    pages = chunks.select(key, "chunk_index", F.explode(F.sequence(*ends)).alias("page_no"))
    near = pages.join(equations.where("label <> ''").select(key, "page_no", "label"), [key, "page_no"])
    return near.groupBy(key, "chunk_index").agg(F.array_sort(F.collect_set(F.struct("page_no", "label"))).alias("labels"))


def printed_labels(text: Column, labels: Column) -> Column:
    """The labels that a text, white space apart, prints."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return F.get(F.transform(F.array(bare(text)), lambda t: F.filter(labels, lambda x: F.contains(t, bare(x["label"])))), F.lit(0))


def equations_of_chunks(chunks: DataFrame, equations: DataFrame, key: str = "doc_id", ends: tuple[str, str] = ("page_start", "page_end")) -> DataFrame:
    """``(key, chunk_index, equations)``: of chunks with their first and last page and text, the ``equations`` (key, page_no,
    label) on these pages that the text, white space apart, prints; as (page_no, label) in order.

    A chunk's pages meet the equations on them without its text, which is asked only for labels that lie there.
    """
    met = chunks.select(key, "chunk_index", "text").join(labels_on_pages(chunks, equations, key, ends), [key, "chunk_index"])
    return met.select(key, "chunk_index", printed_labels(F.col("text"), F.col("labels")).alias("equations")).where(F.size("equations") > 0)


def source_runs(pages: DataFrame, key: str) -> DataFrame:
    """A list of pages ``(key, ord, source)`` -> its stretches from one source."""
    at = W.partitionBy(key).orderBy("ord")
    p = pages.withColumn("_n", F.coalesce((~F.col("source").eqNullSafe(F.lag("source").over(at))).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("_n").over(at.rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy(key, "run", "source").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"))


def insert_blank(pages: DataFrame, after: int, key: str = "book") -> DataFrame:
    """An empty page behind the one numbered ``after``; those behind it move on."""
    moved = pages.withColumn("page_no", F.when(F.col("page_no") > after, F.col("page_no") + 1).otherwise(F.col("page_no")))
    blank = pages.where(F.col("page_no") == after).select(*[F.col(key) if c == key else (F.col(c) + 1).alias(c) if c == "page_no" else F.lit("").alias(c) if c == "text" else F.lit(None).cast(t).alias(c) for c, t in pages.dtypes])
    return moved.unionByName(blank)
