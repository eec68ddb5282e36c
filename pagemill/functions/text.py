"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\x0B\\f\\r]+", " "))


def margin_key(c: Column) -> Column:
    """Runs of digits become one #, so that page numbers don't tell lines apart."""
    return F.regexp_replace(c, "[0-9]+", "#")


def is_blank(c: Column) -> Column:
    return normalise(c) == ""


def has_leader(c: Column) -> Column:
    """A dotted leader, as lines of a contents list have."""
    return c.rlike("\\.( ?\\.){3}|\\.{2,} ?[0-9]{1,4}$")


def ellipsize(c: Column, longest: int = 72, keep: int = 70) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    s = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9.-]", "-"), F.lit("-"))
    return F.when(s == "", "x").otherwise(s)


def safe_name(c: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(c, '[\\\\/:*?"<>|]', "_"), 1, longest)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def heading_depth(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
