"""Paragraphs joined from lines, and their packing into chunks.

Paragraphs come from each page by itself, in one narrow pass; sections and packing are the folds of :mod:`.flow`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.grades import grade, issues
from ..sources.scratch import Tables
from .analysis import repeated_digests
from .exports import contents_pages
from .flow import flow, packed
from .markup import labels_on_pages, printed_labels

SPACE = re.compile(r"\s+")
LEADER, BLOCK, HEADING, LICENCE, PAGE_NUMBER = map(re.compile, (ln.LEADER, ln.BLOCK, ln.HEADING, ln.LICENCE, ln.PAGE_NUMBER))
PARAGRAPHS = "doc_id bigint, page_no int, seq int, text string, units array<string>"


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in tokens of four characters; out of range values are moved to the nearest allowed ones."""

    target: int = 600
    overlap: float = 0.15
    least: int = 48
    prefix: bool = True

    @property
    def total(self) -> int:
        return min(max(self.target, 48), 4000) * 4

    @property
    def carried(self) -> int:
        return int(self.total * min(max(self.overlap, 0.0), 0.5))

    @property
    def limit(self) -> int:
        return max(200, self.total - 160 if self.prefix else self.total)

    @property
    def floor(self) -> int:
        return min(max(1, self.least) * 4, self.limit)


def paragraphs(text: str | None, drop: frozenset[str] = frozenset(), margins: list[bool] | None = None) -> Iterator[str]:
    """Paragraphs of a page: lines are joined until one starts a block, ends a sentence or is a heading.

    A page number goes where ``margins`` says that its line is in one; elsewhere it may be part of a formula.
    """
    held = ""
    for k, raw in enumerate((text or "").split("\n")):
        line = SPACE.sub(" ", raw).strip()
        if not line or line in drop or (margins and k < len(margins) and margins[k] and PAGE_NUMBER.search(line)):
            continue
        line = LICENCE.sub("", line).rstrip(" ,;–-") if LICENCE.search(line) else line
        if not line or LEADER.search(line):
            continue
        if not held:
            held = line
        elif held[-1] == "-" and held[-2:-1].isalpha() and line[0].islower():
            held = held[:-1] + line
        elif BLOCK.search(line) or held[-1] in ".!?" or is_heading(held):
            yield held
            held = line
        else:
            held += " " + line
    if held:
        yield held


def among(text: str | None, digests: list[bytes] | None) -> frozenset[str]:
    """The lines of a page whose MD5 is among ``digests``."""
    if not digests or not text:
        return frozenset()
    known = frozenset(digests)
    lines = {SPACE.sub(" ", raw).strip() for raw in text.split("\n")}
    return frozenset(x for x in lines if hashlib.md5(x.encode(), usedforsecurity=False).digest() in known)


def is_heading(line: str) -> bool:
    return len(line) < 70 and line[-1:] != "." and bool(HEADING.search(line))


def units(paragraph: str, budget: int) -> Iterator[str]:
    """The paragraph if it fits, else its sentences, and slices of those that don't."""
    if len(paragraph) <= budget:
        yield paragraph
        return
    for sentence in re.split(r"(?<=[.!?;:])\s+", paragraph):
        for at in range(0, len(sentence), budget):
            yield sentence[at : at + budget]


def page_paragraphs(pages: DataFrame, limit: int, drop: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """``(doc_id, page_no, text[, margins])`` -> ``(doc_id, page_no, seq, text, units)``; units have ``limit`` characters at most.

    Lines ``(doc_id, line)``, or their MD5 ``(doc_id, digest)``, in ``drop`` and pages ``(doc_id, page_no)`` in ``skip`` are left
    out. ``margins`` tells of each line whether it stands in the page's margin.
    """
    margins = F.col("margins") if "margins" in pages.columns else F.lit(None).cast("array<boolean>")
    own = pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text", margins.alias("margins"))
    # What is left out comes as one row a document, so texts meet it once.
    out = []
    if drop is not None:
        out.append(drop.select("doc_id", (F.col("digest") if "digest" in drop.columns else F.unhex(F.md5("line"))).alias("line"), F.lit(None).cast("int").alias("page")))
    if skip is not None:
        out.append(skip.select("doc_id", F.lit(None).cast("binary").alias("line"), F.col("page_no").cast("int").alias("page")))
    if out:
        left = reduce(DataFrame.unionByName, out).groupBy("doc_id").agg(F.collect_set("line").alias("dropped"), F.collect_set("page").alias("skipped"))
        own = own.join(left, "doc_id", "left").where(~F.coalesce(F.array_contains("skipped", F.col("page_no")), F.lit(False))).drop("skipped")
    else:
        own = own.withColumn("dropped", F.lit(None).cast("array<binary>"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                for k, p in enumerate(paragraphs(r["text"], among(r["text"], r["dropped"]), r["margins"])):
                    out.append((r["doc_id"], r["page_no"], k, p, list(units(p, limit))))
            columns = zip(*out, strict=True) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in PARAGRAPHS.split(", ")])

    return own.mapInArrow(rows, PARAGRAPHS)


def chunks(pages: DataFrame, options: ChunkOptions | None = None, drop: DataFrame | None = None, skip: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """``(doc_id, page_no, text, title[, margins])`` -> chunks with token estimate, grade and issues.

    Lines ``(doc_id, line)``, or their MD5, in ``drop`` and pages ``(doc_id, page_no)`` in ``skip`` are left out. ``markers`` are headings of an
    outline or of clauses, as :func:`.flow.section_markers` gives them; without them paragraphs that look like headings start
    sections. A document has one row for each page_no; null texts and titles are empty.
    """
    o = options or ChunkOptions()
    titles = pages.groupBy("doc_id").agg(F.coalesce(F.min("title"), F.lit("Untitled")).alias("doc_title"))
    text = page_paragraphs(pages.drop("title"), o.limit, drop, skip)
    out = packed(text, flow(text, markers, skip, o.limit, o.floor), o.carried).join(titles, "doc_id")
    section = F.get("sections", F.lit(0))
    whole = F.concat(F.col("doc_title"), F.lit(" — "), section, F.lit("\n\n"), F.col("body")) if o.prefix else F.col("body")
    out = out.select("doc_id", "chunk_index", whole.alias("text"), "page_start", "page_end", section.alias("section_title"), "sections", "context_before")
    out = out.withColumns({"id": F.concat(F.col("doc_id").cast("string"), F.lit("#c"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")), "token_estimate": F.floor(F.length("text") / 4), "issues": issues(F.col("text"))})
    return out.withColumn("quality", grade(F.col("issues"), F.col("text")))


def document_chunks(pages: DataFrame, options: ChunkOptions | None = None, markers: DataFrame | None = None) -> DataFrame:
    """:func:`chunks` without contents pages and without lines that stand on half of a document's pages, of four or more."""
    skip = contents_pages(pages.select("doc_id", "page_no", F.explode(F.split("text", "\n", -1)).alias("text")), "doc_id", "page_no")
    drop = repeated_digests(pages, 0.5, group="doc_id")
    return chunks(pages, options, drop, skip, markers)


def export(chunked: DataFrame, files: DataFrame, labels: DataFrame, equations: DataFrame) -> DataFrame:
    """The chunks' eighteen fields: with names of ``files`` (doc_id, path, title), printed ``labels`` (doc_id, page_no, label)
    and the ``equations`` (doc_id, page_no, label) on their pages that their text prints.

    The chunks are stored in the shared folder, since they are read twice: for their pages, with which all that belongs to a
    chunk is found, and for the texts, which meet that, stored too, in one join.
    """
    tables = Tables(chunked.sparkSession)
    stored = tables.put(chunked)
    tables.tidy()
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    of = stored.select("doc_id", "chunk_index", "page_start", "page_end")
    facts = of.join(labels_on_pages(of, equations), ["doc_id", "chunk_index"], "left")
    for end in ("start", "end"):
        facts = facts.join(labels.select("doc_id", F.col("page_no").alias(f"page_{end}"), F.col("label").alias(f"page_label_{end}")), ["doc_id", f"page_{end}"], "left")
    facts = facts.drop("page_start", "page_end").join(files.select("doc_id", name.alias("source_path"), F.col("title").alias("doc_title")), "doc_id", "left")
    found = tables.put(facts)
    # The plan behind the chunks may have been in use still when their own call asked for its shuffle files to go.
    tables.tidy()
    own = stored.join(found, ["doc_id", "chunk_index"]).withColumn("equations", printed_labels(F.col("text"), F.col("labels")))
    own = own.withColumns({f"pdf_page_{end}": F.col(f"page_{end}") + 1 for end in ("start", "end")})
    stem = F.coalesce(F.regexp_replace("source_path", r"\.[^.]*$", ""), F.col("doc_id").cast("string"))
    ident = F.concat(stem, F.lit("#c"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))
    return own.select(
        ident.alias("id"), "text", "source_path", "doc_title", "page_start", "page_end", "section_title", "chunk_index", "token_estimate", "quality", "issues",
        "pdf_page_start", "pdf_page_end", "page_label_start", "page_label_end", "sections", "context_before", F.coalesce("equations", F.array().cast("array<struct<page_no: int, label: string>>")).alias("equations"),
    )
