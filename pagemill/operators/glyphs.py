"""Lines built from a page's glyphs, and the numbered equations among them.

A page is one group: its glyphs are a fold in the order in which they were drawn.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Code points of symbol pieces with the text they stand for, and of marks.
PIECES = {
    "(": [(0xF8EB, 0xF8ED), (0x239B, 0x239D)],
    ")": [(0xF8F6, 0xF8F8), (0x239E, 0x23A0)],
    "[": [(0xF8EE, 0xF8F0), (0x23A1, 0x23A3)],
    "]": [(0xF8F9, 0xF8FB), (0x23A4, 0x23A6)],
    "{": [(0xF8F1, 0xF8F3), (0x23A7, 0x23A9)],
    "}": [(0xF8FC, 0xF8FE), (0x23AB, 0x23AD)],
    "/": [(0xF8E7, 0xF8E7), (0x23AF, 0x23AF)],
    "": [(0xF8E5, 0xF8E6), (0xF8F4, 0xF8F5), (0x23AA, 0x23AA), (0x23AE, 0x23AE)],
}
MARKS = {0xF8E8: "®", 0xF6DA: "®", 0xF8E9: "©", 0xF6D9: "©", 0xF8EA: "™", 0xF6DB: "™"}
PIECE = {p: text for text, spans in PIECES.items() for a, b in spans for p in range(a, b + 1)}
LABEL = re.compile(r"(?<![0-9.])\((?:[A-Za-z]+[0-9]*|[0-9]+)\.[0-9]+(?:\.?[a-z])?N?\)(?!\s*\()")
PROSE = re.compile(r"(?<![A-Za-z])[a-z]{4,}")
Box = tuple[float, float, float, float]


@dataclass
class Line:
    text: str = ""
    boxes: list[Box] = field(default_factory=list)

    @property
    def centre(self) -> float:
        return (min(b[1] for b in self.boxes) + max(b[3] for b in self.boxes)) / 2


def same_spot(a: Box, b: Box) -> bool:
    """Half of two boxes' union is shared; flat ones share a base line and half a width."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    if min(size) <= 0:
        return abs(a[1] - b[1]) <= 0.5 and wide >= 0.5 * max(a[2] - a[0], b[2] - b[0])
    shared = max(wide, 0) * max(high, 0)
    return shared >= 0.5 * (sum(size) - shared)


def code_points(units: list[tuple[int, Box]]) -> list[tuple[int, Box]]:
    """UTF-16 units -> code points; lone halves become U+FFFD."""
    out: list[tuple[int, Box]] = []
    k = 0
    while k < len(units):
        u, box = units[k]
        k += 1
        if 0xD800 <= u < 0xDC00 and k < len(units) and 0xDC00 <= units[k][0] < 0xE000:
            u = 0x10000 + ((u - 0xD800) << 10) + units[k][0] - 0xDC00
            k += 1
        elif 0xD800 <= u < 0xE000:
            u = 0xFFFD
        out.append((u, box))
    return out


def repair(units: list[tuple[int, Box]]) -> tuple[list[Line], int]:
    """The page's lines and the number of glyphs drawn twice."""
    points = code_points(units)
    lines, dropped = [Line()], 0
    seen: dict[int, list[Box]] = {}
    tall, before, family = 0.0, 0, None
    for k, (p, box) in enumerate(points):
        c = chr(p)
        if c == "\r":
            continue
        if c == "\n":
            lines.append(Line())
            before, family = 0, None
            continue
        if not c.isspace():
            spots = seen.setdefault(p, [])
            ligature = c == "f" and before == p and bool(spots) and spots[-1] == box
            if not ligature and any(same_spot(box, s) for s in spots):
                dropped += 1
                continue
            spots.append(box)
            # Of a ligature only the second letter is let through.
            before = 0 if ligature else p
        else:
            before = p
        if p in PIECE:
            text = PIECE[p]
            if not text or text == family:
                continue
            family = text
        else:
            family = None
            if p in MARKS:
                text = MARKS[p]
            elif unicodedata.category(c) == "Cc" and c != "\t":
                after = chr(points[k + 1][0]) if k + 1 < len(points) else ""
                flat = tall > 0 and box[3] - box[1] <= 0.45 * tall
                text = "-" if flat and lines[-1].text[-1:].isalnum() and after.isalnum() else "�"
            elif 0x2010 <= p <= 0x2012:
                text = "-"
            elif 0x1D400 <= p <= 0x1D7FF or p == 0x210E:
                text = unicodedata.normalize("NFKC", c)
            else:
                text = c
        if text.isalpha():
            tall = box[3] - box[1]
        lines[-1].text += text
        lines[-1].boxes += [box] * len(text)
    return lines, dropped


def equations(lines: list[Line], width: float) -> list[tuple[str, str, bool]]:
    """(label, body, stacked) of each equation numbered at the right; those without a body are none."""
    lines = [x for x in lines if x.text.strip()]
    found: dict[int, re.Match[str]] = {}
    for n, line in enumerate(lines):
        for m in LABEL.finditer(line.text):
            box = line.boxes[m.start()]
            left = [b[2] for c, b in zip(line.text[: m.start()], line.boxes, strict=False) if not c.isspace()]
            rightmost = not line.text[m.end() :].strip()
            if rightmost and box[0] >= 0.55 * width and (not left or box[0] - max(left) >= 0.8 * (box[3] - box[1])):
                found[n] = m
    out = []
    for n, m in sorted(found.items()):
        box = lines[n].boxes[m.start()]
        centre, high = (box[1] + box[3]) / 2, box[3] - box[1]
        own = [n]
        for step in (-1, 1):
            k = n + step
            while 0 <= k < len(lines) and k not in found and abs(lines[k].centre - centre) <= 1.6 * high and len(PROSE.findall(lines[k].text)) < 2:
                own.append(k)
                k += step
        parts = [lines[k].text[: m.start()] if k == n else lines[k].text for k in sorted(own)]
        body = " ".join(" ".join(parts).split())
        spread = [lines[k].centre for k in own if k != n or lines[n].text[: m.start()].strip()]
        if body:
            out.append((m[0], body, max(spread) - min(spread) > 0.5 * high))
    return out


def _units(page: pd.DataFrame) -> list[tuple[int, Box]]:
    page = page.sort_values("idx")
    return list(zip(page["unit"].astype(int), page[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), strict=True))


GLYPHS = ("doc_id", "page_no", "idx", "unit", "x0", "y0", "x1", "y1")


def repaired_lines(glyphs: DataFrame) -> DataFrame:
    """``(doc_id, page_no, idx, unit, x0, y0, x1, y1)`` -> lines, with the page's number of glyphs drawn twice."""

    def page(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lines, dropped = repair(_units(group))
        return pd.DataFrame([(*key, n, x.text, dropped) for n, x in enumerate(lines)], columns=["doc_id", "page_no", "line_no", "text", "dropped"])

    return glyphs.select(*GLYPHS).groupBy("doc_id", "page_no").applyInPandas(page, "doc_id bigint, page_no bigint, line_no int, text string, dropped int")


def page_equations(glyphs: DataFrame, width: float) -> DataFrame:
    """The numbered equations of each page."""

    def page(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *e) for e in equations(repair(_units(group))[0], width)], columns=["doc_id", "page_no", "label", "body", "stacked"])

    return glyphs.select(*GLYPHS).groupBy("doc_id", "page_no").applyInPandas(page, "doc_id bigint, page_no bigint, label string, body string, stacked boolean")
