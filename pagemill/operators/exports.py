"""What stands around an export of chunks: contents pages, summaries, suspect pages, titles, page lists and earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grades as gr
from ..functions import lines as ln
from ..functions.text import ellipsize, has_leader, normalise
from .markup import equations_of_chunks

LONGEST_TITLE = 110
SUSPECT_PAGES = 12


def contents_pages(lines: DataFrame, *keys: str) -> DataFrame:
    """Pages of a contents list: five leaders, or five entries that are two fifths of the lines with text."""
    t = lines.withColumn("t", normalise(F.col("text"))).where("t <> ''")
    counted = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(has_leader(F.col("t"))).alias("leaders"), F.count_if(ln.is_entry(F.col("t"))).alias("entries"))
    return counted.where("leaders >= 5 or (entries >= 5 and entries >= n_lines * 0.4)")


def suspect_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages with characters that no font maps, or that the text is not expected to have; with both counts."""
    unmapped = F.regexp_count("text", F.lit(f"[{gr.UNMAPPED}]"))
    unexpected = F.regexp_count("text", F.lit(f"[^{gr.UNMAPPED}{gr.EXPECTED}]"))
    return pages.where("text is not null").select(key, "page_no", unmapped.alias("unmapped"), unexpected.alias("unexpected")).where("unmapped + unexpected > 0")


def section_counts(pages: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of each document: 0 without pages, 1 without paragraphs."""
    own = paragraphs.groupBy(key).agg(F.countDistinct("section").alias("n"))
    return pages.groupBy(key).agg(F.count("page_no").alias("n_pages")).join(own, key, "left").select(key, F.when(F.col("n_pages") == 0, 0).otherwise(F.coalesce("n", F.lit(1))).alias("sections"))


def export_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, page_no, token_estimate, quality)`` of chunks -> counts, the sum of tokens and the first twelve suspect pages."""
    suspect = F.col("quality") == "suspect"
    pages = F.slice(F.array_sort(F.collect_set(F.when(suspect, F.col("page_no")))), 1, SUSPECT_PAGES)
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_estimate").alias("tokens"), F.count_if(suspect).alias("suspect"), F.count_if(F.col("quality") == "check").alias("check"), F.array_join(pages, ",").alias("suspect_pages")
    )


def html_counters(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Items ``(key, kind, quality, clipped)`` of an HTML text -> how many of each kind, suspect and clipped ones."""
    kinds = {"headings": "heading", "paragraphs": "paragraph", "equations": "equation", "tables": "table", "figures": "figure", "images": "image"}
    return items.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()], F.count_if(F.col("quality") == "suspect").alias("suspect"), F.count_if("clipped").alias("clipped"))


def equation_quality(issues: Column) -> Column:
    """An equation is never simply right: with issues it is suspect, without it is to be checked."""
    return F.when(F.size(issues) > 0, "suspect").otherwise("check")


def chunk_equations(chunks: DataFrame, equations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks ``(key, chunk_index, first_page, last_page, text)`` with the labels of the equations ``(key, page_no, label)``
    on their pages that their text prints, white space apart."""
    found = equations_of_chunks(chunks, equations, key, ("first_page", "last_page"))
    labels = F.array_distinct(F.transform("equations", lambda x: x["label"]))
    return found.select(key, "chunk_index", F.array_join(F.array_sort(labels), ",").alias("equations"))


def valid_hits(hits: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits ``(key, page_no, char_start, length)`` whose range the page's present text still has."""
    now = pages.select(key, "page_no", F.length("text").alias("n"))
    return hits.join(now, [key, "page_no"]).where("char_start >= 0 and length > 0 and char_start + length <= n").drop("n")


def same_texts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents ``(key, text, n_pages)`` that agree in normalised text and number of pages, as pairs with the first of them."""
    of = documents.select(key, F.sha2(F.lower(normalise(F.coalesce("text", F.lit("")))), 256).alias("sha"), "n_pages")
    first = of.groupBy("sha", "n_pages").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return of.join(first, ["sha", "n_pages"]).where(F.col(key) != F.col("first")).select("first", F.col(key).alias("copy"))


def clean_title(c: Column) -> Column:
    return ellipsize(normalise(F.coalesce(c, F.lit(""))), LONGEST_TITLE, LONGEST_TITLE)


def sub_headings(clauses: DataFrame) -> DataFrame:
    """The numbered sub-headings of a document that is about to be merged, as one flat list of titles and pages."""
    kept = F.contains("number", F.lit(".")) & (F.col("title") != "") & (F.length("title") <= LONGEST_TITLE) & ~F.col("title").rlike(ln.EXERCISE)
    return clauses.where(kept).select("doc_id", "number", clean_title(F.concat_ws("  ", "number", "title")).alias("label"), "page_no")


def kept_outlines(clauses: DataFrame) -> DataFrame:
    """Clauses of documents that have two or more; a lone one is no outline."""
    n = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses")).where("n_clauses >= 2")
    return clauses.join(n, "doc_id")


def suggested_titles(files: DataFrame, outlines: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """A title for each file ``(key, path)``: its first outline entry, else the first line of 3 to 110 characters with a letter
    on its first page, else its cleaned name."""
    first = outlines.groupBy(key).agg(F.min_by("title", "ord").alias("own"))
    t = lines.where("page_no = 0").select(key, "line_no", clean_title(F.col("text")).alias("t")).where(F.length("t").between(3, LONGEST_TITLE) & F.col("t").rlike(r"\p{L}"))
    line = t.groupBy(key).agg(F.min_by("t", "line_no").alias("line"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    own = F.when(F.trim("own") != "", clean_title(F.col("own")))
    return files.join(first, key, "left").join(line, key, "left").select(key, F.coalesce(own, F.col("line"), clean_title(F.translate(stem, "_-", "  "))).alias("title"))


def insert_pages(pages: DataFrame, other: DataFrame, at: int, group: str = "book") -> DataFrame:
    """``other``'s pages before page ``at`` of the same group; all are numbered anew."""
    n = other.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    own = pages.join(n, group, "left").withColumn("page_no", F.when(F.col("page_no") >= at, F.col("page_no") + F.coalesce("n", F.lit(0))).otherwise(F.col("page_no"))).drop("n")
    total = pages.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    new = other.join(total, group, "left").withColumn("page_no", F.col("page_no") + F.least(F.lit(at), F.coalesce("n", F.lit(0)))).drop("n")
    return own.unionByName(new)


def merged_pages(parts: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """The pages ``(key, page_no, ...)`` of files ``(key, ord)`` as one list: each file's after those of the files before."""
    n = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(files, key)
    starts = n.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(key, "start")
    return parts.join(starts, key).withColumn("page_no", F.col("page_no") + F.col("start")).drop("start")


def extract_pages(pages: DataFrame, wanted: DataFrame, group: str = "book") -> DataFrame:
    """The wanted pages ``(group, page_no)``, each once, in order and numbered anew."""
    kept = pages.join(wanted.select(group, "page_no").distinct(), [group, "page_no"], "left_semi")
    return kept.withColumn("page_no", F.row_number().over(W.partitionBy(group).orderBy("page_no")) - 1)


def moved(files: DataFrame, from_: int, to: int, group: str = "set_id") -> DataFrame:
    """A list's entry ``from_`` at place ``to``, those between one place nearer; places outside the list change nothing."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    o = F.col("ord")
    shift = F.when(o == from_, to).when((o > from_) & (o <= to), o - 1).when((o < from_) & (o >= to), o + 1).otherwise(o)
    return files.withColumn("n", n).withColumn("ord", F.when(F.lit(max(from_, to)) < F.col("n"), shift).otherwise(o)).drop("n")


def pending_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files ``(path, hash)`` that an earlier run has not finished with the same content."""
    return files.join(done.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def marker_paragraphs(markers: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Section markers ``(key, page_no, ord, title)`` with the first paragraph ``(key, page_no, seq, text)`` of their page
    that begins with the title (its first 40 characters, whatever their case), or null."""
    head = F.lower(F.substring(normalise(F.col("title")), 1, 40))
    m = markers.withColumn("head", head)
    met = m.join(paragraphs.select(key, "page_no", "seq", F.lower(normalise(F.col("text"))).alias("t")), [key, "page_no"]).where((F.col("head") != "") & F.startswith("t", F.col("head")))
    first = met.groupBy(key, "page_no", "ord").agg(F.min("seq").alias("seq"))
    return m.drop("head").join(first, [key, "page_no", "ord"], "left")


def live_markers(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of markers matched to paragraphs (or to none: ``seq`` null) those still pending after their page: a match retires all before it."""
    last = F.max(F.when(F.col("seq").isNotNull(), F.col("ord"))).over(W.partitionBy(key, "page_no"))
    return matched.withColumn("last", F.coalesce(last, F.lit(-1))).where("seq is null and ord > last").drop("last", "seq")
