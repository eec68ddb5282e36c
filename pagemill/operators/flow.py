"""A document's flow: the section that each paragraph stands in, and the chunks that paragraphs are packed into.

Both are folds over one document in order, and only what they decide on passes them: of a marker its title and number, of
a paragraph its head, lengths and heading forms. Documents pass a task as a sorted stream; a page's heads are held at a
time. Sections and chunk numbers are joined back to the paragraphs, so texts are gathered for one chunk only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.names import clause_display
from ..functions.text import normalise

FRONT = "Front matter"
#: Markers that a document needs before its outline or its clauses count.
LEAST_MARKERS = 3
#: Characters of a paragraph that its head has, and of a title that a paragraph is held against.
HEAD, TITLE_HEAD = 160, 40


def without_page(title: Column) -> Column:
    """A title without the contents page's number at its end."""
    return F.when(title.rlike(r"\p{L}[^0-9]*\s[0-9]{1,4}$"), F.regexp_replace(title, r"\s+[0-9]{1,4}$", "")).otherwise(title)


def section_markers(outline: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """``(doc_id, page_no, ord, title, number)``: a document's ``outline`` (doc_id, page_no, ord, title) if it has three
    entries or more, else its ``clauses`` (doc_id, page_no, ord, number, title) if these are three, else the outline.

    Entries without a page or title are none, nor are clauses whose title has no word of three letters.
    """
    title = without_page(normalise(F.col("title")))
    own = outline.where("page_no is not null").select("doc_id", "page_no", "ord", title.alias("title"), F.lit(None).cast("string").alias("number")).where("title <> ''")
    if clauses is None:
        return own
    named = without_page(F.trim(clause_display(F.col("number"), F.col("title"))))
    other = clauses.where(F.col("title").rlike(r"\p{L}{3}")).select("doc_id", "page_no", "ord", named.alias("title"), "number")
    n = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_own"))
    m = other.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_other"))
    chosen = n.join(m, "doc_id", "full").select("doc_id", ((F.coalesce("n_own", F.lit(0)) < LEAST_MARKERS) & (F.coalesce("n_other", F.lit(0)) >= LEAST_MARKERS)).alias("by_clause"))
    return own.join(chosen.where("not by_clause"), "doc_id", "left_semi").union(other.join(chosen.where("by_clause"), "doc_id", "left_semi"))


@dataclass(frozen=True)
class Marker:
    title: str
    number: str | None
    dotted: str | None

    def starts(self, p: Paragraph) -> bool:
        """Whether the paragraph prints this heading."""
        if self.number is not None:
            return begins(p.head, self.number.rstrip("."))
        key = self.title[:TITLE_HEAD].lower()
        return (key != "" and p.head.lower().startswith(key)) or bool(self.dotted and p.dotted and begins(p.head, self.dotted))


@dataclass(frozen=True)
class Paragraph:
    head: str
    size: int
    dotted: str
    printed: str | None


def begins(text: str, number: str) -> bool:
    """Whether a text begins with a whole number, with a full stop behind it or not."""
    rest = text[len(number) :]
    return text.startswith(number) and (rest[:1].isspace() or rest in ("", ".") or (rest[0] == "." and rest[1].isspace()))


@dataclass
class SectionFlow:
    """The sections of one document's paragraphs, page by page."""

    titles: dict[str, str] = field(default_factory=dict)
    current: str = FRONT

    def page(self, markers: list[Marker], paragraphs: list[Paragraph]) -> list[tuple[str, bool, bool]]:
        """(section, whether it is a printed heading, whether a section starts) of each paragraph.

        Headings that no paragraph prints switch at the top, the last of them for good. A printed one switches where it
        stands and retires all that wait before it. What still waits at the end carries on.
        """
        waiting = [m for m in markers if any(m.starts(p) for p in paragraphs)]
        unseen = [m for m in markers if m not in waiting]
        if unseen:
            self.current = unseen[-1].title
        top, out = bool(unseen), []
        for p in paragraphs:
            hit = next((k for k, m in enumerate(waiting) if m.starts(p)), None)
            title = None
            if hit is not None:
                title = waiting[hit].title
                del waiting[: hit + 1]
            elif p.dotted and p.size < 120 and self.titles.get(p.dotted, self.current) != self.current:
                title = self.titles[p.dotted]
            if title is not None:
                self.current = p.printed if p.printed is not None else title
            out.append((self.current, title is not None and p.printed is not None, title is not None or top))
            top = False
        if waiting:
            self.current = waiting[-1].title
        return out


@dataclass
class Packing:
    """Chunk numbers of one document's units, from their lengths."""

    limit: int
    floor: int
    index: int = 0
    raw: int = 0
    body: int = 0

    def add(self, size: int, stripped: int, starts: bool) -> tuple[int, bool]:
        """(the unit's chunk, whether the chunk begins with it since the one before was full)."""
        full = False
        if self.raw:
            if starts and self.raw >= self.floor:
                closed = self.body >= self.floor
            else:
                closed = full = self.raw + size + 1 > self.limit and self.body > 0
            if closed:
                self.index, self.raw, self.body = self.index + 1, 0, 0
        self.raw += size + 1
        self.body += stripped + (1 if self.body and stripped else 0)
        return self.index, full


FLOW = "doc_id bigint, page_no int, seq int, section string, heading boolean, starts boolean, chunk array<int>, carried array<boolean>"
EVENT = ("doc_id", "page_no", "kind", "ord", "head", "size", "number", "dotted", "printed", "sizes", "stripped")


def flow(paragraphs: DataFrame, markers: DataFrame | None = None, hidden: DataFrame | None = None, limit: int = 2240, floor: int = 192) -> DataFrame:
    """Of paragraphs ``(doc_id, page_no, seq, text, units)`` their section, and the chunk of each of their units.

    ``markers`` (doc_id, page_no, ord, title, number) are the headings of an outline; those on ``hidden`` pages (doc_id,
    page_no) do not switch sections, but name numbered headings elsewhere. Without markers, paragraphs that look like headings
    start sections.
    """
    t = F.col("text")
    none = lambda c: F.lit(None).cast(c)
    # Only markers are held against heads.
    dotted, head = (F.regexp_extract("text", ln.BODY_HEADING, 1), F.left(t, F.lit(HEAD))) if markers is not None else (F.lit(""), F.lit(""))
    printed = F.when(F.length(t) <= 120, ln.printed_heading(t)) if markers is not None else F.when(ln.is_heading(t), t)
    events = paragraphs.select(
        "doc_id", "page_no", F.lit(2).alias("kind"), F.col("seq").alias("ord"), head.alias("head"), F.length(t).alias("size"), none("string").alias("number"), dotted.alias("dotted"),
        printed.alias("printed"), F.transform("units", F.length).alias("sizes"), F.transform("units", lambda u: F.length(F.trim(u))).alias("stripped"),
    )
    if markers is not None:
        own = F.when(F.contains("number", F.lit(".")), F.rtrim(F.col("number"), F.lit("."))).otherwise(F.regexp_extract("title", ln.BODY_HEADING, 1))
        m = markers.select("doc_id", "page_no", F.lit(1).alias("kind"), "ord", F.col("title").alias("head"), F.length("title").alias("size"), "number", own.alias("dotted"), none("string").alias("printed"), none("array<int>").alias("sizes"), none("array<int>").alias("stripped"))
        named = m.where("dotted <> ''").groupBy("doc_id", "dotted").agg(F.min_by("head", F.struct("page_no", "ord")).alias("head"))
        known = named.select("doc_id", F.lit(-1).alias("page_no"), F.lit(0).alias("kind"), F.lit(0).alias("ord"), "head", F.lit(0).alias("size"), none("string").alias("number"), "dotted", none("string").alias("printed"), none("array<int>").alias("sizes"), none("array<int>").alias("stripped"))
        if hidden is not None:
            m = m.join(hidden.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
        events = events.unionByName(m).unionByName(known)
    by_heading = markers is None
    dealt = events.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in EVENT[1:4]), *EVENT[4:]).repartition("doc_id").sortWithinPartitions("doc_id", "page_no", "kind", "ord")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        sections, packing = SectionFlow(), Packing(limit, floor)
        marks: list[Marker] = []
        held: list[tuple[dict, Paragraph]] = []
        out: list[tuple] = []

        def close() -> None:
            if by_heading:
                found = []
                for _, p in held:
                    sections.current = p.printed or sections.current
                    found.append((sections.current, p.printed is not None, p.printed is not None))
            else:
                found = sections.page(marks, [p for _, p in held])
            for (r, _), (section, heading, starts) in zip(held, found, strict=True):
                units = [packing.add(n, s, starts and k == 0) for k, (n, s) in enumerate(zip(r["sizes"], r["stripped"], strict=True))]
                out.append((r["doc_id"], r["page_no"], r["ord"], section, heading, starts, [c for c, _ in units], [f for _, f in units]))
            marks.clear()
            held.clear()

        def made() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            columns = zip(*out, strict=True) if out else [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in FLOW.split(", ")])
            out.clear()
            return batch

        for b in batches:
            for r in b.to_pylist():
                if place != (r["doc_id"], r["page_no"]):
                    close()
                    if place is None or place[0] != r["doc_id"]:
                        sections, packing = SectionFlow(), Packing(limit, floor)
                    place = r["doc_id"], r["page_no"]
                if r["kind"] == 0:
                    sections.titles[r["dotted"]] = r["head"]
                elif r["kind"] == 1:
                    marks.append(Marker(r["head"], r["number"], r["dotted"] or None))
                else:
                    held.append((r, Paragraph(r["head"], r["size"], r["dotted"], r["printed"])))
            yield made()
        close()
        yield made()

    return dealt.mapInArrow(rows, FLOW)


def packed(paragraphs: DataFrame, flowed: DataFrame, carried: int) -> DataFrame:
    """Chunks ``(doc_id, chunk_index, body, page_start, page_end, sections, context_before)`` of paragraphs and their flow.

    A chunk that follows a full one has the last ``carried`` characters of that one as its context, from a whole word on.
    """
    # Both meet by document in one exchange, and whatever follows stays where they met.
    at, its = ["doc_id", "page_no", "seq"], ["section", "chunk", "carried"]
    none = lambda df, *names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    rows = paragraphs.select(*at, "units", *none(flowed, *its)).unionByName(flowed.select(*at, *none(paragraphs, "units"), *its)).repartition("doc_id")
    both = rows.groupBy(*at).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("units", *its)))
    each = both.select("doc_id", "page_no", "seq", "section", F.posexplode(F.arrays_zip("units", "chunk", "carried")).alias("unit", "u"))
    # All units of a chunk fit its budget.
    parts = F.array_sort(F.collect_list(F.struct("page_no", "seq", "unit", "section", F.col("u.units").alias("text"))))
    out = each.groupBy("doc_id", F.col("u.chunk").alias("chunk_index")).agg(parts.alias("parts"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.max("u.carried").alias("follows"))
    names = F.transform("parts", lambda x: x["section"])
    changes = F.filter(names, lambda x, k: (k == 0) | (F.get("names", k - 1) != x))
    body = normalise(F.array_join(F.transform("parts", lambda x: x["text"]), " "))
    out = out.withColumn("names", names).withColumns({"sections": changes, "body": body}).drop("names", "parts")
    before = F.lag("body").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    tail = F.right("before", F.lit(carried))
    space = F.locate(" ", tail)
    context = F.when(F.col("follows") & F.lit(carried > 0), F.when((F.length("before") > carried) & (space > 1), F.substring(tail, space + 1, F.lit(carried))).otherwise(tail)).otherwise("")
    return out.withColumn("before", before).withColumn("context_before", context).drop("before", "follows")
