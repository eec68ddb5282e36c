"""Addresses printed in texts, without a link of their own, and where they stand on the page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import merged_rects, rects_in_order

FOUND = "{key} bigint, ord int, char_start int, length int, target string"
#: What an address may hold inside, and what it may end in: no bracket that it didn't open, no sign that ends a sentence.
_INSIDE = r"""[^\x00-\x20<>"()\[\]{}]"""
_PAIR = r"""\([^\x00-\x20<>"()]*\)|\[[^\x00-\x20<>"\[\]]*\]"""
_LAST = r"""[^\x00-\x20<>"()\[\]{}.,;:!?'’”»…]"""
WEB = rf"(?i:https?://|ftp://|\bwww\.)(?:{_INSIDE}|{_PAIR})*(?:{_LAST}|{_PAIR})"
MAIL = r"(?i:\bmailto:)?\b[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.[A-Za-z0-9]){0,8}[A-Za-z0-9-]{0,62}\.[A-Za-z]{2,24}\b"
#: Reads alike in Java, Python (ASCII classes) and RE2.
ADDRESS = f"{WEB}|{MAIL}"


def completed(address: str) -> str:
    """The address with its scheme: http for one that begins with www, mailto for mail."""
    low = address.lower()
    if low.startswith("www."):
        return "http://" + address
    return address if low.startswith(("http", "ftp", "mailto:")) else "mailto:" + address


def find_addresses(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` -> web, FTP and mail addresses in reading order, with their places.

    One narrow pass; texts without an @, :// or www are passed over at once, and only those with an address reach Python,
    which gives the places. A full stop, comma or bracket
    behind an address is not part of it; brackets inside, as in ``/a_(b)``, are. Null and empty texts give none;
    repeated rows give theirs each.
    """
    slim = pages.select(F.col(key).cast("bigint").alias(key), "text").where(F.col("text").rlike("@|://|(?i:www)")).where(F.col("text").rlike(ADDRESS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = re.compile(ADDRESS, re.ASCII)
        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column("text"), strict=True):
                out += [(k, n, m.start(), m.end() - m.start(), completed(m[0])) for n, m in enumerate(search.finditer(t.as_py()))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "ord", "char_start", "length", "target"])

    return slim.mapInArrow(rows, FOUND.format(key=key))


def address_rects(found: DataFrame, chars: DataFrame | Callable[[Column], Column], key: str = "doc_id") -> DataFrame:
    """A rectangle for each line that an address runs over, from the page's characters ``(key, seq, x0, y0, x1, y1)``.

    The address's places meet the characters by (key, seq), so a page's size doesn't matter. Where a rule sets the text,
    ``chars`` is that rule, from a place to its box (x0, y0, x1, y1): then only the addresses' own characters are made, in one
    narrow pass.
    """
    at = F.sequence("char_start", F.col("char_start") + F.col("length") - 1)
    if callable(chars):
        rows = found.select(key, "ord", "target", F.transform(at, lambda k: F.struct(k.alias("seq"), chars(k).alias("b"))).alias("all"))
        return rects_in_order(rows, key, "ord", "target")
    places = found.select(key, "ord", F.explode(at).alias("seq"))
    rects = merged_rects(places.join(chars.select(key, F.col("seq").cast("int").alias("seq"), "x0", "y0", "x1", "y1"), [key, "seq"]), key, "ord")
    return rects.join(found.select(key, "ord", "target"), [key, "ord"])
