"""Boxes on pages: graphics, ruling lines, bands, captions' regions, equations, recognised words, ends of measures.

Pages run upwards: ``y1`` is a box's top, ``y0`` its bottom. Keys name pages, so a group is one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as ln

#: Share of a page's height at its top and at its bottom where running titles stand.
MARGIN = 0.08
RESOLUTION, LONGEST_EDGE = 300, 4_200
LEAST_CONFIDENCE = 40.0
TICK = 4.0
CAPTION_SIZE, CAPTION_PADDING = 9.0, 2.0


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """All of a line lies in the page's top or bottom margin."""
    return (y0 >= height * (1 - MARGIN)) | (y1 <= height * MARGIN)


def is_upright(angle: Column) -> Column:
    """A glyph that is not turned; negative angles are unknown ones."""
    return (angle < 0) | (F.abs(F.sin(angle)) < 0.35)


def union_box(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def usable_graphics(graphics: DataFrame, width: float, height: float) -> DataFrame:
    """Without empty ones, page frames and backgrounds, and those in the margins."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return graphics.where((w >= 0) & (h >= 0) & ((w > 0) | (h > 0)) & (w * h < width * height * 0.5) & ~in_margin(F.col("y0"), F.col("y1"), F.lit(height)))


def ruling_lines(edges: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """Horizontal (axis y) and vertical (x) rules of each region: thin, long, no longer than the region, near it, and
    more than 2 from the last one kept, by place."""
    r = regions.select(key, *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    near = edges.join(r, key).where((F.col("x1") >= F.col("rx0") - 3) & (F.col("x0") <= F.col("rx1") + 3) & (F.col("y1") >= F.col("ry0") - 3) & (F.col("y0") <= F.col("ry1") + 3))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = (h <= 1.5) & (w >= 6) & (w <= F.col("rx1") - F.col("rx0") + 12)
    tall = (w <= 1.5) & (h >= 6) & (h <= F.col("ry1") - F.col("ry0") + 12)
    axis = F.when(flat, "y").when(tall, "x")
    at = F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    places = near.select(key, axis.alias("axis"), at.alias("at")).where("axis is not null").groupBy(key, "axis").agg(F.sort_array(F.collect_set("at")).alias("all"))
    # The last one kept decides, so this is a fold over one region's rules.
    kept = F.aggregate("all", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.coalesce(F.try_element_at(a, F.lit(-1)), x) > 2), F.concat(a, F.array(x))).otherwise(a))
    return places.select(key, "axis", F.explode(kept).alias("at"))


def bands(rules: DataFrame, key: str = "key", least: float = 2.0) -> DataFrame:
    """What lies between neighbouring rules more than ``least`` apart."""
    after = F.lead("at").over(W.partitionBy(key, "axis").orderBy("at"))
    return rules.withColumn("end", after).where(F.col("end") - F.col("at") > least).select(key, "axis", F.col("at").alias("start"), "end")


def line_owners(lines: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """Each line ``(key, line, box)`` with the region ``(key, region, caption_line, box)`` it belongs to, or null: that whose
    caption it is, else the first one that holds its centre, to within a point."""
    r = regions.select(key, "region", "caption_line", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("rx0") - 1, F.col("rx1") + 1) & cy.between(F.col("ry0") - 1, F.col("ry1") + 1)
    caption = F.col("line") == F.col("caption_line")
    own = lines.join(r, key).where(caption | inside).groupBy(key, "line").agg(F.min(F.struct((~caption).alias("later"), "region"))["region"].alias("region"))
    return lines.select(key, "line").join(own, [key, "line"], "left")


def free_equations(equations: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """Equations whose centre no table or figure holds."""
    r = regions.select(F.col(key).alias("rk"), *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return equations.join(r, (F.col(key) == F.col("rk")) & cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1")), "left_anti")


def text_block_below(lines: DataFrame, captions: DataFrame, key: str = "key") -> DataFrame:
    """The box of an unruled table: lines under its caption up to the first wide gap, caption or line of prose; two at least.

    ``lines``: (key, line, text, box); ``captions``: (key, caption, box), each with a key of its own.
    """
    c = captions.select(key, "caption", F.col("y0").alias("below"), F.greatest(F.lit(4.0), F.col("y1") - F.col("y0")).alias("h"))
    under = lines.join(c, key).where((F.col("line") != F.col("caption")) & (F.trim("text") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") <= F.col("below") + 1))
    down = W.partitionBy(key, "caption").orderBy(F.desc("y1"), "line")
    bottom = F.least(F.col("below"), F.coalesce(F.min("y0").over(down.rowsBetween(W.unboundedPreceding, -1)), F.col("below")))
    stop = (bottom - F.col("y1") > 2.2 * F.col("h")) | ln.is_region_caption(F.trim("text")) | (F.regexp_count("text", F.lit(ln.PROSE_WORD)) >= 6)
    open_ = under.withColumn("stop", stop.cast("int")).withColumn("stopped", F.sum("stop").over(down.rowsBetween(W.unboundedPreceding, 0))).where("stopped = 0")
    return open_.groupBy(key, "caption").agg(F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("n_lines >= 2")


def separators(labels: DataFrame, ink: DataFrame, key: str = "key") -> DataFrame:
    """Where to part two stacked equations: the middle of the widest gap in the ``ink`` (y0, y1) between their labels' centres
    ``(key, hi, lo)``, or halfway where nothing is blank."""
    cut = labels.join(ink.select(key, "y0", "y1"), key, "left").where(F.col("y0").isNull() | ((F.col("y1") > F.col("lo")) & (F.col("y0") < F.col("hi"))))
    clipped = cut.select(key, "hi", "lo", F.greatest("lo", "y0").alias("a"), F.least("hi", "y1").alias("b"))
    # A last piece of no height at the lower label ends the last gap.
    rows = clipped.where("a is not null").unionByName(labels.select(key, "hi", "lo", F.col("lo").alias("a"), F.col("lo").alias("b")))
    down = W.partitionBy(key, "hi", "lo").orderBy(F.desc("b"), F.desc("a"))
    cursor = F.coalesce(F.min("a").over(down.rowsBetween(W.unboundedPreceding, -1)), F.col("hi"))
    gaps = rows.withColumn("cursor", cursor).withColumn("gap", F.col("cursor") - F.col("b"))
    best = gaps.groupBy(key, "hi", "lo").agg(F.max(F.struct("gap", F.col("cursor").alias("top"), F.col("b").alias("end"))).alias("g"))
    return best.select(key, "hi", "lo", F.when(F.col("g.gap") > 0, (F.col("g.top") + F.col("g.end")) / 2).otherwise((F.col("hi") + F.col("lo")) / 2).alias("at"))


def column_gaps(runs: DataFrame, left: float, right: float, step: float, key: str = "key", row: str = "row") -> DataFrame:
    """Columns' gaps by votes: stretches of ``x`` where at least 60 % of the data rows have no run, but one to the right.

    Data rows have two runs ``(key, row, x0, x1)`` or more, the widest under 55 % of the width.
    """
    own = W.partitionBy(key, row)
    reach = F.max("x1").over(own.orderBy("x0", "x1").rowsBetween(W.unboundedPreceding, -1))
    each = runs.select(key, row, "x0", "x1", reach.alias("reach"), F.count(F.lit(1)).over(own).alias("n"), F.max(F.col("x1") - F.col("x0")).over(own).alias("widest"))
    data = each.where((F.col("n") >= 2) & (F.col("widest") < 0.55 * (right - left)))
    need = data.groupBy(key).agg(F.ceil(F.count_distinct(row) * 0.6).alias("need"))
    # A row votes for the steps between what its runs have reached and the next run: one more where they begin, one less behind.
    begin = F.greatest(F.lit(0), F.coalesce(F.floor((F.col("reach") - left) / step) + 1, F.lit(0)))
    end = F.least(F.lit(int((right - left) / step)), F.ceil((F.col("x0") - left) / step) - 1)
    voted = data.select(key, begin.alias("a"), end.alias("b")).where("a <= b")
    turns = voted.select(key, F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("by")), F.struct((F.col("b") + 1).alias("k"), F.lit(-1).alias("by")))).alias("t"))
    turns = turns.groupBy(key, F.col("t.k").alias("k")).agg(F.sum("t.by").alias("by"))
    along = W.partitionBy(key).orderBy("k")
    votes = turns.withColumns({"votes": F.sum("by").over(along), "next": F.lead("k").over(along)}).join(need, key)
    clear = votes.withColumn("clear", F.col("votes") >= F.col("need"))
    opens = F.col("clear") & ~F.coalesce(F.lag("clear").over(along), F.lit(False))
    island = clear.withColumn("g", F.sum(opens.cast("int")).over(along)).where("clear")
    return island.groupBy(key, "g").agg((left + F.min("k") * step).alias("start"), (left + (F.max("next") - 1) * step).alias("end")).drop("g")


def pixel_size(width: Column, height: Column) -> Column:
    """Pixels to draw a page for recognition: 300 to an inch, the longer edge 4,200 at most."""
    w, h = width * (RESOLUTION / 72), height * (RESOLUTION / 72)
    k = F.when(F.greatest(w, h) > LONGEST_EDGE, LONGEST_EDGE / F.greatest(w, h)).otherwise(1.0)
    return F.struct(*[F.greatest(F.lit(1), F.floor(x * k + 0.5).cast("int")).alias(n) for n, x in (("width", w), ("height", h))])


def recognised_words(words: DataFrame) -> DataFrame:
    """Words ``(key, word, confidence, x, y, w, h)`` in pixels from the top -> boxes on the page, those of little confidence or size left out.

    Pages come with their size in points (page_width, page_height), in pixels (px_width, px_height) and their crop's origin (ox, oy).
    """
    sx, sy = F.col("page_width") / F.col("px_width"), F.col("page_height") / F.col("px_height")
    kept = words.where((F.trim("word") != "") & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("w") > 0) & (F.col("h") > 0))
    bottom = F.col("oy") + F.col("page_height") - (F.col("y") + F.col("h")) * sy
    left = F.col("ox") + F.col("x") * sx
    return kept.select("key", "word", left.alias("x0"), bottom.alias("y0"), (left + F.col("w") * sx).alias("x1"), (bottom + F.col("h") * sy).alias("y1"))


def end_ticks(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The two short bars across a distance's ends; none for a distance of nothing."""
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    nx, ny = -(y1 - y0) / length * TICK, (x1 - x0) / length * TICK

    def bar(x: Column, y: Column) -> Column:
        return F.struct((x - nx).alias("x0"), (y - ny).alias("y0"), (x + nx).alias("x1"), (y + ny).alias("y1"))

    return F.when(length < 1e-9, F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>")).otherwise(F.array(bar(x0, y0), bar(x1, y1)))


def caption_box(x: Column, y: Column, width: Column) -> Column:
    """The box behind a caption of that width around its anchor."""
    w, h = width / 2 + CAPTION_PADDING, F.lit(CAPTION_SIZE / 2 + CAPTION_PADDING)
    return F.struct((x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def appearance_box(bounds: Column, caption: Column, line_width: Column) -> Column:
    """What a measure's drawing covers: its bounds with ends and stroke, and its caption."""
    pad = line_width + TICK
    return F.struct(
        F.least(bounds["x0"] - pad, caption["x0"]).alias("x0"), F.least(bounds["y0"] - pad, caption["y0"]).alias("y0"), F.greatest(bounds["x1"] + pad, caption["x1"]).alias("x1"), F.greatest(bounds["y1"] + pad, caption["y1"]).alias("y1")
    )


def merged_rects(chars: DataFrame, *keys: str, overlap: float = 0.35, pad: float = 0.12) -> DataFrame:
    """Rectangles of characters ``(keys, seq, box)`` in order: one grows while the next character overlaps it upright by
    ``overlap`` of its own height or more. Boxes under half a point in either direction are left out; each is padded a little."""
    box = F.struct("x0", "y0", "x1", "y1")
    rows = chars.where((F.col("x1") - F.col("x0") >= 0.5) & (F.col("y1") - F.col("y0") >= 0.5)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", box.alias("b")))).alias("all"))
    return rects_in_order(rows, *keys, overlap=overlap, pad=pad)


def rects_in_order(rows: DataFrame, *keys: str, overlap: float = 0.35, pad: float = 0.12) -> DataFrame:
    """:func:`merged_rects` of rows ``(keys, all)`` that have their characters ``(seq, b)``, b a box, in order: one narrow pass."""
    kind = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
    large = F.filter("all", lambda c: (c["b"]["x1"] - c["b"]["x0"] >= 0.5) & (c["b"]["y1"] - c["b"]["y0"] >= 0.5))

    def step(done: Column, item: Column) -> Column:
        c, last = item["b"], F.try_element_at(done, F.lit(-1))
        shared = F.least(last["y1"], c["y1"]) - F.greatest(last["y0"], c["y0"])
        wider = F.struct(F.least(last["x0"], c["x0"]).alias("x0"), F.least(last["y0"], c["y0"]).alias("y0"), F.greatest(last["x1"], c["x1"]).alias("x1"), F.greatest(last["y1"], c["y1"]).alias("y1"))
        goes_on = F.coalesce(shared >= overlap * (c["y1"] - c["y0"]), F.lit(False))
        return F.when(goes_on, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(c)))

    found = rows.select(*keys, F.posexplode(F.aggregate(large, F.array().cast(kind), step)).alias("rect", "r"))
    edge = (F.col("r.y1") - F.col("r.y0")) * pad
    return found.select(*keys, "rect", F.col("r.x0").alias("x0"), (F.col("r.y0") - edge).alias("y0"), F.col("r.x1").alias("x1"), (F.col("r.y1") + edge).alias("y1"))


def selection(chars: DataFrame, ends: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Between the characters ``(key, first, last)``, in either order, of ``(key, seq, ch, box)``: the text, and its rectangles."""
    e = ends.select(key, F.least("first", "last").alias("a"), F.greatest("first", "last").alias("z"))
    own = chars.join(e, key).where(F.col("seq").between(F.col("a"), F.col("z")))
    text = own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda x: x["ch"]), "").alias("text"))
    return text, merged_rects(own, key)


def flow_order(lines: DataFrame, regions: DataFrame, key: str = "key") -> DataFrame:
    """A page's lines and regions in reading order ``(key, seq, kind, id)``.

    A region stands where its first line was; its lines are in it. One without lines stands before
    the first line whose centre is below it, or at the end.
    """
    owned = line_owners(lines, regions, key)
    first = owned.where("region is not null").groupBy(key, "region").agg(F.min("line").alias("line"))
    r = regions.select(key, "region", F.col("y0").alias("ry0")).join(first, [key, "region"], "left")
    below = lines.select(key, F.col("line").alias("under"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    placed = r.join(below, key, "left").groupBy(key, "region").agg(F.first("line").alias("line"), F.min(F.when(F.col("cy") < F.col("ry0"), F.col("under"))).alias("under"), F.max("under").alias("last"))
    at = F.coalesce("line", "under", F.col("last") + 1, F.lit(0))
    items = placed.select(key, at.alias("at"), F.lit(0).alias("k"), F.col("region").alias("id"), F.lit("region").alias("kind"))
    items = items.unionByName(owned.where("region is null").select(key, F.col("line").alias("at"), F.lit(1).alias("k"), F.col("line").alias("id"), F.lit("line").alias("kind")))
    return items.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy("at", "k", "id")) - 1).select(key, "seq", "kind", "id")
