"""Widths of text in the standard sans-serif font, and its lines in a given width."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# The font's published widths, in thousandths of its size, of code points 32 to 126; of all others.
WIDTHS = (
    *(278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278),
    *(556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556),
    *(1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778),
    *(667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556),
    *(333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556),
    *(556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584),
)
OTHER = 556
INSET, LINE = 3, 1.25
SLACK_WIDTH, SLACK_LINES = 1.06, 0.4


def width(text: str) -> int:
    return sum(WIDTHS[p - 32] if 32 <= p < 127 else OTHER for p in map(ord, text))


def fitting(word: str, room: float) -> Iterator[str]:
    """A word in pieces that fit, of one character at least; the last piece last."""
    at, used = 0, 0
    for k, c in enumerate(word):
        w = width(c)
        if used + w > room and k > at:
            yield word[at:k]
            at, used = k, 0
        used += w
    yield word[at:]


def wrap(text: str | None, points: float, size: float) -> list[str]:
    """Lines no wider than ``points``; line breaks stay, too long words are cut."""
    room = max(width("W"), points * 1000 / size)
    out = []
    for paragraph in re.split("\r\n|[\n\r\f\x85\u2028\u2029]", text or ""):
        if not paragraph:
            out.append("")
            continue
        held, used = "", 0
        for word in paragraph.split(" "):
            w = width(word)
            if held and used + WIDTHS[0] + w <= room:
                held, used = f"{held} {word}", used + WIDTHS[0] + w
                continue
            if held:
                out.append(held)
            *cut, held = fitting(word, room)
            out += cut
            used = width(held)
        if held:
            out.append(held)
    return out or [""]


def fitted_size(lines: list[str], points: float, size: float) -> tuple[float, float]:
    """Width and height of the box around wrapped lines."""
    widest = max(map(width, lines), default=0) * size / 1000
    return min(points, widest * SLACK_WIDTH + 2 * INSET), (len(lines) + SLACK_LINES) * size * LINE + 2 * INSET


def wrapped(points: float, size: float = 11.0):
    """A column function: text -> its lines within a box of that width; null has one empty line."""

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wrap(t if isinstance(t, str) else "", points - 2 * INSET, size))

    return lines
