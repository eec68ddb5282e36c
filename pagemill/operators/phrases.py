"""Phrase hits with options, their snippets, and totals of a search over many texts."""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = "{key} bigint, ord int, char_start int, length int, snippet string"
#: What counts as white space: all of Unicode's, and null characters.
BLANK = r"[\x00\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def folded(c: str) -> str:
    """Lower case, where that is one character, so that places stay true."""
    low = c.lower()
    return low if len(low) == 1 else c


@cache
def _same_folded() -> dict[str, str]:
    """Of each character what else folds to it."""
    out: dict[str, str] = defaultdict(str)
    for c in map(chr, range(sys.maxunicode + 1)):
        if folded(c) != c:
            out[folded(c)] += c
    return out


def phrase_pattern(term: str, match_case: bool = False) -> str | None:
    """A pattern that Java and Python read alike, for ``term`` with any white space between its words; null if it has none."""

    def one(c: str) -> str:
        low = folded(c)
        same = c if match_case else low + _same_folded().get(low, "")
        return "[" + "".join(f"\\u{ord(x):04x}" if ord(x) < 0x10000 else x for x in same) + "]"

    words = [w for w in re.split(BLANK + "+", term) if w]
    return f"{BLANK}+".join("".join(map(one, w)) for w in words) or None


def _search(term: str, match_case: bool, whole_word: bool, overlapping: bool) -> re.Pattern[str] | None:
    own = phrase_pattern(term, match_case)
    if own is None:
        return None
    own = rf"(?<![^\W_]){own}(?![^\W_])" if whole_word else own
    return re.compile(f"(?=({own}))" if overlapping else f"({own})")


def occurrences(text: str, term: str, match_case: bool = False, whole_word: bool = False, overlapping: bool = False) -> list[tuple[int, int]]:
    """(start, length) in the text as it is; case is folded a character at a time."""
    search = _search(term, match_case, whole_word, overlapping)
    return [(m.start(1), m.end(1) - m.start(1)) for m in search.finditer(text)] if search else []


def snippet(text: str, start: int, length: int, context: int = 44) -> str:
    a, b = max(0, start - context), min(len(text), start + length + context)
    return ("…" if a else "") + " ".join(text[a:b].split()) + ("…" if b < len(text) else "")


def find_phrases(pages: DataFrame, term: str, match_case: bool = False, whole_word: bool = False, overlapping: bool = False, key: str = "doc_id") -> DataFrame:
    """One row a hit. One narrow pass; only texts with a hit (of whole words or not) reach Python, which gives the places.

    Null and empty texts and blank terms give no hits; repeated rows give theirs each.
    """
    own = phrase_pattern(term, match_case)
    slim = pages.select(F.col(key).cast("bigint").alias(key), "text").where(F.lit(False) if own is None else F.col("text").rlike(own))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(term, match_case, whole_word, overlapping)
        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column("text"), strict=True):
                text = t.as_py()
                out += [(k, n, m.start(1), m.end(1) - m.start(1), snippet(text, m.start(1), m.end(1) - m.start(1))) for n, m in enumerate(search.finditer(text))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "ord", "char_start", "length", "snippet"])

    return slim.mapInArrow(rows, HITS.format(key=key))


def phrase_count(text: Column, term: str, match_case: bool = False) -> Column:
    """How often a text holds the term, as :func:`find_phrases` counts without further options; null counts as empty."""
    own = phrase_pattern(term, match_case)
    return F.lit(0) if own is None else F.coalesce(F.regexp_count(text, F.lit(own)), F.lit(0))


def search_totals(files: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: files, files with hits and hits in all."""
    each = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return files.select(F.col(key).cast("bigint").alias(key)).join(each, key, "left").agg(F.count(F.lit(1)).alias("files"), F.count("n").alias("files_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))


def phrase_totals(files: DataFrame, term: str, match_case: bool = False) -> DataFrame:
    """The same of a table ``(text)`` in one native pass, without the hits' places."""
    n = files.select(phrase_count(F.col("text"), term, match_case).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") > 0).alias("files_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
