"""Grades of extracted text: ok, check or suspect, with the issues found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of code points.
UNMAPPED = r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}"
EXPECTED = r"\x{9}-\x{D}\x{20}-\x{36F}\x{370}-\x{4FF}\x{1E00}-\x{1EFF}\x{2000}-\x{2BFF}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}"
MATHS = r"[\x{1D400}-\x{1D7FF}\x{210E}\x{2070}-\x{209F}\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{2AFF}]"
VALUE = r"[-+]?[0-9][0-9.,]*%?"
TABLE = rf"(?:^|[ \t\n])(?:{VALUE}[ \t\n]+){{11}}{VALUE}(?:[ \t\n]|$)"
ROMAN_OR_WEB = r"^(?i:[ivxlcdm]+|www.*)$"


def unmapped(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{UNMAPPED}]"))


def unexpected(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{UNMAPPED}{EXPECTED}]"))


def repeated_tokens(c: Column, most: int = 8) -> Column:
    """Distinct tokens with one letter three times in a row, in order of appearance."""
    tokens = F.filter(F.split(c, "[ \\t\\n]+"), lambda t: t.rlike(r"^[\p{L}0-9,]+$") & t.rlike(r"(\p{L})\1\1") & ~t.rlike(ROMAN_OR_WEB))
    return F.slice(F.array_distinct(tokens), 1, most)


def issues(c: Column) -> Column:
    """Found issues in their fixed order; null has none."""
    found = [(unmapped(c) > 0, "unmapped"), (unexpected(c) > 0, "unexpected"), (F.size(repeated_tokens(c)) > 0, "duplicated"), (c.rlike(TABLE), "table")]
    return F.array_compact(F.array(*[F.when(on, name) for on, name in found]))


def grade(issues: Column, text: Column) -> Column:
    bad = F.arrays_overlap(issues, F.array(F.lit("unmapped"), F.lit("unexpected"), F.lit("duplicated")))
    return F.when(bad, "suspect").when((F.size(issues) > 0) | text.rlike(MATHS), "check").otherwise("ok")
