"""What changed between two revisions of documents: the lines added and removed on each page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "doc_id bigint, page_no int, change string, first int, last int, at int"


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; halves of ``a`` in turn, so that space stays linear."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i == 1:
            found = np.flatnonzero(b[j:n] == a[i])
            if len(found):
                out.append((i, j + int(found[0])))
            continue
        mid = (i + m) // 2
        cut = j + int((_lengths(a[i:mid], b[j:n]) + _lengths(a[mid:m][::-1], b[j:n][::-1])[::-1]).argmax())
        todo += [(i, mid, j, cut), (mid, m, cut, n)]
    return sorted(out)


def line_changes(old: str | None, new: str | None) -> list[tuple[str, int, int, int]]:
    """(removed or added, first and last line in their own revision, lines before them in the other), as few lines as can be."""
    a, b = ([] if t is None else t.split("\n") for t in (old, new))
    number = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    kept = [*common(*(np.array([number[x] for x in t], np.int64) for t in (a, b))), (len(a), len(b))]
    out, i, j = [], 0, 0
    for k, l in kept:
        if k > i:
            out.append(("removed", i, k - 1, j))
        if l > j:
            out.append(("added", j, l - 1, k))
        i, j = k + 1, l + 1
    return out


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of two revisions' pages ``(doc_id, page_no, text)`` the stretches of lines that differ.

    ``removed`` lines are numbered in the old page, ``added`` ones in the new; ``at`` counts the lines before them in the other
    revision. A page in one revision only is all removed or all added, as is a null text. Equal pages never reach Python; pages are unique.
    """
    key = ["doc_id", "page_no"]
    sides = [d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), F.col("text").alias(n)) for d, n in ((old, "old"), (new, "new"))]
    changed = sides[0].join(sides[1], key, "full").where(~F.col("old").eqNullSafe(F.col("new")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["doc_id"], r["page_no"], *c) for r in b.to_pylist() for c in line_changes(r["old"], r["new"])]
            columns = zip(*out, strict=True) if out else [()] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in CHANGES.split(", ")])

    return changed.mapInArrow(rows, CHANGES)
