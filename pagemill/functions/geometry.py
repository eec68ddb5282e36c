"""Places on pages as column expressions: turned pages, segments, sizes and right directions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points in a millimetre; ISO sizes in millimetres, portrait.
POINTS = 72 / 25.4
SIZES = {"A4": (210, 297), "A3": (297, 420), "A2": (420, 594), "A1": (594, 841)}
#: Two segments this close to parallel don't cross; a crossing may lie so far past an end, as a share.
PARALLEL, SLACK = 1e-9, 1e-6


def turned(rotation: Column, cases: list[tuple[Column, Column]]) -> Column:
    """The case of the rotation in quarter turns clockwise, as ``struct<x, y>``."""
    r = F.pmod(rotation, F.lit(4))
    each = [F.struct(x.alias("x"), y.alias("y")) for x, y in cases]
    return F.when(r == 1, each[1]).when(r == 2, each[2]).when(r == 3, each[3]).otherwise(each[0])


def to_device(x: Column, y: Column, width: Column, height: Column, rotation: Column, scale: Column, left: Column, bottom: Column) -> Column:
    """A place on a page (from its lower left, cropped at left and bottom) -> on the drawn page, from its upper left."""
    w, h = width * scale, height * scale
    across, down = (x - left) * scale, h - (y - bottom) * scale
    return turned(rotation, [(across, down), (h - down, across), (w - across, h - down), (down, w - across)])


def to_page(x: Column, y: Column, width: Column, height: Column, rotation: Column, scale: Column, left: Column, bottom: Column) -> Column:
    """The inverse of :func:`to_device`."""
    w, h = width * scale, height * scale
    p = turned(rotation, [(x, y), (y, h - x), (w - x, h - y), (w - y, x)])
    return F.struct((p["x"] / scale + left).alias("x"), (height - p["y"] / scale + bottom).alias("y"))


def constrained(dx: Column, dy: Column) -> Column:
    """A step turned to the nearest multiple of 45 degrees, ties to the even one, of the same length."""
    length = F.sqrt(dx * dx + dy * dy)
    angle = F.rint(F.atan2(dy, dx) / (math.pi / 4)) * (math.pi / 4)
    still = length < 1e-9
    return F.struct(F.when(still, dx).otherwise(length * F.cos(angle)).alias("x"), F.when(still, dy).otherwise(length * F.sin(angle)).alias("y"))


def crossing(a: str, b: str) -> Column:
    """Where two segments, structs ``(x0, y0, x1, y1)``, cross, as ``struct<x, y>``; else null."""
    ax, ay, bx, by = F.col(f"{a}.x0"), F.col(f"{a}.y0"), F.col(f"{b}.x0"), F.col(f"{b}.y0")
    rx, ry, sx, sy = F.col(f"{a}.x1") - ax, F.col(f"{a}.y1") - ay, F.col(f"{b}.x1") - bx, F.col(f"{b}.y1") - by
    turn = rx * sy - ry * sx
    safe = F.when(F.abs(turn) >= PARALLEL, turn)
    t, u = ((bx - ax) * sy - (by - ay) * sx) / safe, ((bx - ax) * ry - (by - ay) * rx) / safe
    return F.when(t.between(-SLACK, 1 + SLACK) & u.between(-SLACK, 1 + SLACK), F.struct((ax + t * rx).alias("x"), (ay + t * ry).alias("y")))


def page_size(width: Column, height: Column, landscape: Column) -> Column:
    """Millimetres -> points; a landscape page is turned only if it is taller than wide."""
    swap = landscape & (height > width)
    return F.struct((F.when(swap, height).otherwise(width) * POINTS).alias("width"), (F.when(swap, width).otherwise(height) * POINTS).alias("height"))


def named_size(name: Column, landscape: Column) -> Column:
    """Points of an ISO size, named in any case; null if unknown."""
    at = F.create_map(*[x for k, (w, h) in SIZES.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    mm = F.try_element_at(at, F.upper(name))
    return F.when(mm.isNotNull(), page_size(mm["w"], mm["h"], landscape))


def units_a_point(paper_mm: Column, real_mm: Column, unit_mm: Column) -> Column:
    """A scale from a length on paper and in reality, in units; null unless all are positive."""
    return F.when((paper_mm > 0) & (real_mm > 0) & (unit_mm > 0), 25.4 / 72 * real_mm / paper_mm / unit_mm)


def measured(value: Column, unit: Column, decimals: int, square: bool = False) -> Column:
    """"1,234.50 m", with a raised 2 for areas; zero to six decimals."""
    n = min(max(decimals, 0), 6)
    return F.concat(F.format_number(value, n), F.lit(" "), unit, F.lit("²" if square else ""))


# The corners of a tick, as shares of its box.
TICK = ((0.12, 0.52), (0.40, 0.16), (0.90, 0.88))


def tick_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The three corners of a tick drawn in a box, whichever way the box's sides come."""
    left, low, w, h = F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0)
    return F.array(*(F.struct((left + a * w).alias("x"), (low + b * h).alias("y")) for a, b in TICK))
