"""Annexes, captions, and the references that page texts make to them and to clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise
from .pageops import CUES

# Letters of annexes; what captions and references look like.
LETTERS = r"N\.?A\.?|Z?[A-Z]"
ANNEX_ALONE = rf"^Annex\s+({LETTERS})\s*$"
ANNEX_CLAUSE = rf"^({LETTERS})((?:\.[0-9]{{1,3}}){{1,4}})\s+(\p{{Lu}}.{{1,120}}?)\s*$"
CAPTION_NUMBER = r"[A-Z]{0,2}\.?[0-9]{1,2}(?:\.[0-9]{1,3})?[a-z]?"
CAPTION_LINE = rf"^(Figure|Table)\s+({CAPTION_NUMBER})\s*[-‐‒–—:]"
#: In the order in which they claim their places.
KINDS = [
    ("Clause", re.compile(rf"(?:{CUES})\s+([0-9]{{1,2}}(?:\.[0-9]{{1,3}}){{1,4}})(?:\s*\([0-9]{{1,3}}\))?")),
    ("Annex", re.compile(rf"Annex\s+({LETTERS})\b")),
    ("Caption", re.compile(rf"(?:Figure|Table)\s+{CAPTION_NUMBER}")),
]
CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
FOUND = "doc_id bigint, page_no int, kind int, start int, end int, key string"


def annex_headings(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_no, line_no, text)`` -> the first sighting of each annex and its clauses; letters without dots."""
    part = [F.regexp_extract("text", ANNEX_CLAUSE, k) for k in (1, 2, 3)]
    alone = F.regexp_extract("text", ANNEX_ALONE, 1)
    letters = F.upper(F.replace(F.when(alone != "", alone).otherwise(part[0]), F.lit("."), F.lit("")))
    t = lines.select("doc_id", "page_no", "line_no", F.when(alone != "", letters).otherwise(F.concat(letters, part[1])).alias("number"), normalise(part[2]).alias("title"))
    first = t.where("number <> ''").groupBy("doc_id", "number").agg(F.min_by(F.struct("title", "page_no"), F.struct("page_no", "line_no")).alias("f"))
    return first.select("doc_id", "number", "f.title", "f.page_no")


def captions(lines: DataFrame) -> DataFrame:
    """The first page of each figure and table that a caption line names."""
    kind, number = (F.regexp_extract("text", CAPTION_LINE, k) for k in (1, 2))
    t = lines.where(F.col("text").rlike(CAPTION_LINE)).select("doc_id", F.concat_ws(" ", kind, number).alias("key"), "page_no")
    return t.groupBy("doc_id", "key").agg(F.min("page_no").alias("page_no"))


def page_map(clauses: DataFrame, annexes: DataFrame, named: DataFrame) -> DataFrame:
    """``(doc_id, key, page_no)`` of everything that can be referred to."""
    both = clauses.select("doc_id", F.col("number").alias("key"), "page_no").unionByName(annexes.select("doc_id", F.col("number").alias("key"), "page_no"))
    return both.unionByName(named.select("doc_id", "key", "page_no")).groupBy("doc_id", F.lower("key").alias("key")).agg(F.min("page_no").alias("page_no"))


def find_references(pages: DataFrame) -> DataFrame:
    """Every reference in ``(doc_id, page_no, text)`` with its place; one narrow pass. Null texts have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, page, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page_no", "text")), strict=True):
                flat = CONTROL.sub(" ", text or "")
                for kind, (name, pattern) in enumerate(KINDS):
                    for m in pattern.finditer(flat):
                        key = " ".join(m[0].split()) if name == "Caption" else m[1].replace(".", "") if name == "Annex" else m[1]
                        out.append((doc, page, kind, m.start(), m.end(), key))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "page_no", "kind", "start", "end", "key"])

    return pages.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), "text").mapInArrow(rows, FOUND)


def cross_references(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """References with the page they lead to.

    Clauses fall back on their longest known prefix, annexes and captions are looked up as
    they are, in any case. Those that lead nowhere or to their own page go; of overlapping
    ones the first in order of kind and place stays. A page's own references are one array.
    """
    parts = F.split("key", r"\.")
    prefixes = F.when(F.col("kind") == 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array("key"))
    place = ["doc_id", "page_no", "kind", "start", "end", "key"]
    tried = find_references(pages).select(*place, F.posexplode(prefixes).alias("depth", "_p"))
    known = targets.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("page_no").alias("target"))
    hit = tried.join(known, (F.col("doc_id") == F.col("_d")) & (F.lower("_p") == F.col("_k")))
    led = hit.groupBy(*place).agg(F.max_by("target", "depth").alias("target")).where("target <> page_no")
    all_of = F.array_sort(F.collect_list(F.struct("kind", "start", "end", "key", "target")))

    def claim(kept, r):
        return F.when(F.exists(kept, lambda k: (r["start"] < k["end"]) & (r["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(r)))

    page = led.groupBy("doc_id", "page_no").agg(all_of.alias("all"))
    kept = page.select("doc_id", "page_no", F.explode(F.aggregate("all", F.filter("all", lambda _: F.lit(False)), claim)).alias("r"))
    names = F.array(*[F.lit(f"{n} " if n != "Caption" else "") for n, _ in KINDS])
    return kept.select("doc_id", "page_no", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.concat(names[F.col("r.kind")], "r.key").alias("label"), F.col("r.target").alias("target"))
