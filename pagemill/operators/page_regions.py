"""Tables and figures by their captions, and the display blocks of equations.

Growing a region is a fold over one page's boxes, so pages pass a task as a sorted stream and are held one at a time; only
pages that have a caption are sent. Blocks of equations need the nearest text on both sides, which ordered windows give.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as ln
from .regions import separators

BOX = ("x0", "y0", "x1", "y1")
#: How far from its caption a table or figure begins; what joins it; the least size of one.
SEED, TOUCH, LEAST_SIZE = 45.0, 4.0, (20.0, 8.0)


def cluster(boxes: np.ndarray, seeds: np.ndarray) -> np.ndarray | None:
    """The box around ``seeds`` (a mask) and all ``boxes`` that touch it, again and again; None if there is none or it is too small."""
    taken = seeds.copy()
    while taken.any():
        own = boxes[taken]
        around = np.array([own[:, 0].min(), own[:, 1].min(), own[:, 2].max(), own[:, 3].max()])
        near = (boxes[:, 0] <= around[2] + TOUCH) & (boxes[:, 2] >= around[0] - TOUCH) & (boxes[:, 1] <= around[3] + TOUCH) & (boxes[:, 3] >= around[1] - TOUCH)
        if not (near & ~taken).any():
            return around if around[2] - around[0] >= LEAST_SIZE[0] and around[3] - around[1] >= LEAST_SIZE[1] else None
        taken |= near
    return None


def by_page(rows: DataFrame, key: str, order: tuple[str, ...], each: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """``each`` page's rows, as a list for each column, in order -> rows (key, *schema)."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    kinds = [types[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        out: list[tuple] = []
        type_: pa.DataType | None = None

        def close() -> None:
            if held:
                page = held[key][0]
                out.extend((page, *r) for r in each(held))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * (len(names) + 1)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (type_, *kinds), strict=True)], [key, *names])
            out.clear()
            return batch

        for b in batches:
            type_ = b.schema.field(key).type
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            keys = columns[key]
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if held and held[key][0] != keys[at]:
                    close()
                for c, values in columns.items():
                    held.setdefault(c, []).extend(values[at:to])
                at = to
            yield made()
        close()
        if out:
            yield made()

    # With a constant besides the key, a union of joins by that key is dealt out anew: as it stands its sides' partitions may not match.
    return rows.repartition(F.col(key), F.lit(0)).sortWithinPartitions(key, *order).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


def below(caption: tuple, boxes: np.ndarray, low: float) -> np.ndarray | None:
    some = boxes[(boxes[:, 3] <= caption[1] + 2) & (boxes[:, 1] >= low - 1)]
    return cluster(some, some[:, 3] >= caption[1] - SEED)


def above(caption: tuple, boxes: np.ndarray, high: float) -> np.ndarray | None:
    some = boxes[(boxes[:, 1] >= caption[3] - 2) & (boxes[:, 3] <= high + 1)]
    return cluster(some, some[:, 1] <= caption[3] + SEED)


def limits(caption: tuple, others: np.ndarray, height: float) -> tuple[float, float]:
    """How far down and up a caption's region may reach: to the neighbouring captions."""
    tops, bottoms = others[:, 3], others[:, 1]
    return max(tops[tops < caption[1]], default=0.0), min(bottoms[bottoms > caption[3]], default=height)


def caption_regions(captions: DataFrame, graphics: DataFrame, height: float, key: str = "key") -> DataFrame:
    """Of captions ``(key, caption, kind, box)`` the cluster of graphics that each belongs to: a table's is looked for below it
    first, a figure's above it. It reaches no further than the neighbouring captions."""
    none = F.lit(None)
    own = captions.select(key, F.col("caption").cast("bigint").alias("caption"), "kind", *BOX)
    near = graphics.join(captions.select(key).distinct(), key, "left_semi").select(key, none.cast("bigint").alias("caption"), none.cast("string").alias("kind"), *BOX)

    def each(page: dict[str, list]) -> list[tuple]:
        box = np.array(list(zip(*(page[c] for c in BOX), strict=True)), float)
        named = [k for k, c in enumerate(page["caption"]) if c is not None]
        boxes, others, out = np.delete(box, named, 0), box[named], []
        for k in named:
            c = tuple(box[k])
            low, high = limits(c, others, height)
            tries = (("below", below, low), ("above", above, high))
            for side, find, end in tries if page["kind"][k] == "Table" else tries[::-1]:
                found = find(c, boxes, end)
                if found is not None:
                    out.append((page["caption"][k], side, *found.tolist()))
                    break
        return out

    return by_page(own.unionByName(near), key, ("caption", *BOX), each, "caption bigint, side string, x0 double, y0 double, x1 double, y1 double")


#: A figure's legend lies between it and its caption: no further down than this, and without sentences of so many words.
LEGEND_REACH, SENTENCE_WORDS = 300.0, 8
#: Gap, in heights of the caption, that ends an unruled table; words that make a line prose.
TABLE_GAP, PROSE_WORDS = 2.2, 6
WORD4 = re.compile(r"(?<!\w)[^\W\d_]{4,}(?!\w)")
PAGE_REGIONS = "caption bigint, kind string, label string, title string, how string, x0 double, y0 double, x1 double, y1 double, lines array<bigint>"


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.minimum(a[:2], b[:2]), np.maximum(a[2:], b[2:])])


def meets(boxes: np.ndarray, box: np.ndarray, by: float = 0.0) -> np.ndarray:
    return (boxes[:, 0] <= box[2] + by) & (boxes[:, 2] >= box[0] - by) & (boxes[:, 1] <= box[3] + by) & (boxes[:, 3] >= box[1] - by)


class Page:
    """One page's lines and graphics: the regions that its captions name."""

    def __init__(self, texts: list[str], marks: list[tuple[str, str]], lines: np.ndarray, margin: np.ndarray, graphics: np.ndarray, height: float) -> None:
        self.texts, self.marks, self.lines, self.margin, self.graphics, self.height = texts, marks, lines, margin, graphics, height
        self.wide = lines[:, 2] > lines[:, 0]
        self.is_caption = np.array([bool(kind) for kind, _ in marks], bool) if marks else np.zeros(0, bool)

    def wrapped(self, k: int) -> tuple[str, np.ndarray, list[int]]:
        """A caption's whole text, box and further lines: those straight below that go on in lower case."""
        text, box, more = self.texts[k], self.lines[k], []
        for j in range(k + 1, len(self.texts)):
            t, b = self.texts[j], self.lines[j]
            if not t[:1].islower() or not self.wide[j] or box[1] - b[3] > 0.6 * (box[3] - box[1]) or b[3] > box[1] + 1:
                break
            text, box = f"{text} {t}", union(box, b)
            more.append(j)
        return text, box, more

    def over_legend(self, k: int, high: float) -> np.ndarray | None:
        """The drawing above a figure's legend, unless sentences or captions lie between."""
        top, g = self.lines[k][3], self.graphics
        some = g[(g[:, 1] >= top - 2) & (g[:, 1] <= top + LEGEND_REACH) & (g[:, 3] <= high + 1)]
        if not len(some):
            return None
        nearest = some[:, 1].min()
        between = ~self.margin & self.wide & (self.lines[:, 1] >= top - 1) & (self.lines[:, 3] <= nearest + 1)
        for j in np.flatnonzero(between):
            t = self.texts[j]
            if self.is_caption[j] or (t.endswith((".", ":")) and len(t.split()) >= SENTENCE_WORDS):
                return None
        return cluster(some, some[:, 1] <= nearest + SEED)

    def text_block(self, k: int, low: float) -> np.ndarray | None:
        """An unruled table: lines under the caption up to a wide gap, a caption or prose; two at least."""
        c = self.lines[k]
        under = [j for j in range(len(self.texts)) if j != k and self.wide[j] and self.texts[j] and not self.margin[j] and self.lines[j][3] <= c[1] + 1 and self.lines[j][1] >= low]
        bottom, out = c[1], []
        for j in sorted(under, key=lambda j: (-self.lines[j][3], j)):
            b = self.lines[j]
            prose = sum(w == w.lower() for w in WORD4.findall(self.texts[j])) >= PROSE_WORDS
            if bottom - b[3] > TABLE_GAP * max(4.0, c[3] - c[1]) or self.is_caption[j] or prose:
                break
            out.append(b)
            bottom = min(bottom, b[1])
        return np.concatenate([np.min(out, 0)[:2], np.max(out, 0)[2:]]) if len(out) > 1 else None

    def grown(self, box: np.ndarray, figure: bool, caption: np.ndarray, low: float, high: float) -> np.ndarray:
        """With text just outside the graphics: header rows, labels around a drawing, a figure's legend."""
        l = self.lines
        own = ~self.margin & self.wide & np.array([bool(t) for t in self.texts], bool) & ~meets(l, caption)
        take = own & meets(l, box, 2.0) & (l[:, 3] <= high) & (l[:, 1] >= low)
        if figure and box[1] >= caption[3] - 2:
            take |= own & (l[:, 1] >= caption[3] - 1) & (l[:, 3] <= box[1] + 1)
        for b in l[take]:
            box = union(box, b)
        return box

    def regions(self) -> list[tuple]:
        found = [(k, *self.wrapped(k)) for k in np.flatnonzero(self.is_caption & ~self.margin & self.wide).tolist()]
        boxes = np.array([b for _, _, b, _ in found]).reshape(-1, 4)
        out = []
        for k, title, c, more in found:
            low, high = limits(tuple(c), boxes, self.height)
            kind, label = self.marks[k]
            if kind == "Table":
                tries = (("below", lambda: below(c, self.graphics, low)), ("above", lambda: above(c, self.graphics, high)), ("text", lambda: self.text_block(k, low)))
            else:
                tries = (("above", lambda: above(c, self.graphics, high)), ("legend", lambda: self.over_legend(k, high)), ("below", lambda: below(c, self.graphics, low)))
            for how, find in tries:
                box = find()
                if box is not None:
                    box = self.grown(np.asarray(box, float), kind == "Figure", c, low, high)
                    out.append((k, kind, f"{kind} {label}", title, how, *box.tolist(), [k, *more]))
                    break
        return out


def page_regions(lines: DataFrame, graphics: DataFrame, height: float, key: str = "key") -> DataFrame:
    """Tables and figures of pages: their caption's line, kind, label, whole title, how they were found, box, and caption's lines.

    ``lines``: (key, line, text, box, margin), line numbers in order from any start; ``graphics``: (key, box). A table is what
    lies below its caption, else above, else the lines below it; a figure what lies above, else above its legend, else below.
    """
    t = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")
    text = lines.select(key, F.col("line").cast("bigint").alias("line"), t.alias("text"), *BOX, "margin")
    part = lambda k: F.when(ln.is_region_caption(F.col("text")), F.regexp_extract("text", ln.REGION_CAPTION, k)).otherwise("")
    text = text.withColumns({"kind": part(1), "label": part(2)})
    pages = text.where("kind <> '' and not margin").select(key).distinct()
    none = F.lit(None)
    own = text.join(pages, key, "left_semi").select(key, "line", "text", "kind", "label", "margin", *BOX)
    near = graphics.join(pages, key, "left_semi").select(key, none.cast("bigint").alias("line"), *(none.cast("string").alias(c) for c in ("text", "kind", "label")), none.cast("boolean").alias("margin"), *BOX)

    def each(page: dict[str, list]) -> list[tuple]:
        box = np.array(list(zip(*(page[c] for c in BOX), strict=True)), float)
        named = [k for k, n in enumerate(page["line"]) if n is not None]
        number = [page["line"][k] for k in named]
        made = Page([page["text"][k] for k in named], [(page["kind"][k], page["label"][k]) for k in named], box[named], np.array([page["margin"][k] for k in named], bool), np.delete(box, named, 0), height)
        return [(number[r[0]], *r[1:-1], [number[j] for j in r[-1]]) for r in made.regions()]

    return by_page(own.unionByName(near), key, ("line", *BOX), each, PAGE_REGIONS)


#: An equation's block reaches so far from its label at most, and stays so far from text.
REACH, CLEAR = 100.0, 1.5


def _nearest(labels: DataFrame, places: DataFrame, up: bool, key: str) -> DataFrame:
    """``labels`` (key, eq, at) with the nearest of ``places`` (key, at) that is not below ``at``, or not above it; null if none."""
    both = labels.select(key, "eq", "at", F.lit(None).cast("double").alias("place"), F.lit(0 if up else 1).alias("k"))
    both = both.unionByName(places.select(key, F.lit(None).cast(labels.schema["eq"].dataType).alias("eq"), "at", F.col("at").alias("place"), F.lit(1 if up else 0).alias("k")))
    order = W.partitionBy(key).orderBy("at", "k")
    found = F.first("place", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)) if up else F.last("place", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("found", found).where("eq is not null").select(key, "eq", "found")


def text_column(lines: DataFrame, width: float, key: str = "key") -> DataFrame:
    """(key, left, right) of each page's longer body lines: the tenth part from the left, nine tenths from the right."""
    body = lines.where("not margin and x1 > x0 and x1 - x0 > y1 - y0").where(F.length(F.trim("text")) >= 15)
    edges = body.groupBy(key).agg(F.sort_array(F.collect_list("x0")).alias("l"), F.sort_array(F.collect_list("x1")).alias("r"))
    at = lambda c, share: F.get(c, F.least(F.size(c) - 1, F.floor(F.size(c) * share).cast("int")))
    return edges.select(key, at("l", 0.1).alias("left"), at("r", 0.9).alias("right"))


def is_text(text: Column, margin: Column) -> Column:
    """What a displayed formula ends at: running text, a caption, a heading, or anything in a margin."""
    return (F.trim(text) != "") & (margin | ln.is_beside_formula(F.trim(text)))


def display_blocks(equations: DataFrame, lines: DataFrame, graphics: DataFrame, width: float, height: float, band: float = 0.08, key: str = "key") -> DataFrame:
    """The block to show for each equation ``(key, eq, box, lx0, ly0, lx1, ly1)``, whose last four are its label's box.

    It spans the text column and reaches up and down to the nearest text, to the gap before the next equation, to the page's
    margins or ``REACH`` from the label; never less than the equation's own box. ``lines``: (key, text, box, margin);
    ``graphics``: (key, box). Where two labels have one centre, order is by eq.
    """
    e = equations.withColumns({"cy": (F.col("ly0") + F.col("ly1")) / 2, "h": F.greatest(F.lit(4.0), F.col("ly1") - F.col("ly0"))})
    text = lines.where(F.col("x1") > F.col("x0")).where(is_text(F.col("text"), F.col("margin")))
    up = _nearest(e.select(key, "eq", (F.col("ly1") + F.col("h") / 4).alias("at")), text.select(key, F.col("y0").alias("at")), True, key).withColumnRenamed("found", "over")
    down = _nearest(e.select(key, "eq", (F.col("ly0") - F.col("h") / 4).alias("at")), text.select(key, F.col("y1").alias("at")), False, key).withColumnRenamed("found", "under")
    order = W.partitionBy(key).orderBy(F.desc("cy"), "eq")
    e = e.withColumns({"before": F.lag("cy").over(order), "after": F.lead("cy").over(order)})
    ink = lines.where("x1 > x0 and not margin").select(key, "y0", "y1").unionByName(graphics.select(key, "y0", "y1"))
    gaps = separators(e.where("after is not null").select(key, F.col("cy").alias("hi"), F.col("after").alias("lo")).distinct(), ink, key)
    first = gaps.select(key, F.col("hi").alias("before"), F.col("lo").alias("cy"), F.col("at").alias("part_up"))
    second = gaps.select(key, F.col("hi").alias("cy"), F.col("lo").alias("after"), F.col("at").alias("part_down"))
    out = e.join(up, [key, "eq"]).join(down, [key, "eq"]).join(first, [key, "before", "cy"], "left").join(second, [key, "cy", "after"], "left")
    out = out.join(text_column(lines, width, key), key, "left")
    top = F.least(F.col("cy") + REACH, F.lit(height * (1 - band)), F.col("over") - CLEAR, F.col("part_up"))
    bottom = F.greatest(F.col("cy") - REACH, F.lit(height * band), F.col("under") + CLEAR, F.col("part_down"))
    left, right = F.coalesce("left", F.lit(50.0)), F.coalesce("right", F.lit(width - 50.0))
    return out.select(key, "eq", F.least(left, "x0").alias("x0"), F.least(bottom, "y0").alias("y0"), F.greatest(right, "x1").alias("x1"), F.greatest(top, "y1").alias("y1"))
