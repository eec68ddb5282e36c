"""Titles, citations and reasons of bad text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import normalise

# Placeholder titles, operators of formulas, values of tables, table captions.
PLACEHOLDER = r"^(?i:untitled(?:[ \t]+document)?|document[0-9]*|[0-9]+|[\w\-. ]+\.(?:pdf|docx?|indd|qxp|tex|dvi))$"
WORD_PREFIX = "^(?i:Microsoft Word - )"
DANGLING = r"[=+≤≥<>×·−][ \t\n]*[=+≤≥<>×·]|\([ \t\n]*\)"
TABLE_VALUE = r"^(?:\(?[≤≥<>±+−–-]?[0-9]+(?:[.,][0-9]+)*[%)]?|[≤≥<>–—-])$"
TABLE_NAME = r"\bTable\s+[A-Z]?\.?[0-9]+(?:\.[0-9]+)*[a-z]?"
TABLE_RUN = 12


def clean_title(c: Column) -> Column:
    """Plain hyphens, no word processor's prefix and its extension, one space, no final dot; null is empty."""
    t = F.translate(F.coalesce(c, F.lit("")), "‐‑‒", "---")
    t = F.when(t.rlike(WORD_PREFIX), F.regexp_replace(F.regexp_replace(t, WORD_PREFIX, ""), r"\.[^.]*$", "")).otherwise(t)
    return F.regexp_replace(normalise(t), "[. ]+$", "")


def document_title(metadata: Column, running: Column, path: Column) -> Column:
    """The stated title unless a placeholder, else the running title, else the file's name, else "Untitled"."""
    own = clean_title(metadata)
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    tried = [F.when(own.rlike(PLACEHOLDER), "").otherwise(own), clean_title(running), clean_title(stem)]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tried], F.lit("Untitled"))


def clause_display(number: Column, title: Column) -> Column:
    head = F.when(number == "NA", "National Annex").when(number.rlike("^Z?[A-Z]$"), F.concat(F.lit("Annex "), number)).otherwise(number)
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", head).otherwise(F.concat(head, F.lit("  "), title))


def cite_passage(source: Column, clause: Column, page: Column, quote: Column) -> Column:
    at = F.concat(source, F.when(F.coalesce(clause, F.lit("")) == "", "").otherwise(F.concat(F.lit(", cl. "), clause)), F.lit(", p. "), page)
    return F.when(F.coalesce(F.trim(quote), F.lit("")) == "", at).otherwise(F.concat(F.lit("“"), F.trim(quote), F.lit("”\n— "), at))


def cite_clause(source: Column, number: Column, title: Column, page: Column) -> Column:
    kind = F.when(number.rlike("^[A-Z]{1,2}$"), ", Annex ").otherwise(", cl. ")
    named = F.when(F.coalesce(F.trim(title), F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), F.trim(title), F.lit(")")))
    return F.concat(source, kind, number, named, F.lit(", p. "), page)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def scramble_reason(c: Column, stacked: Column) -> Column:
    """Why a formula's text can't be read in a line; null if it can. Later reasons hold only without earlier ones."""
    t = tokens(c)
    n = F.size(t)
    indices = F.filter(t, lambda x: (F.length(x) >= 3) & F.contains(x, F.lit(",")) & x.rlike(r"\p{L}"))
    pieces = (n >= 6) & (F.size(F.filter(t, lambda x: F.length(x) <= 2)) >= n * 0.6)
    return (
        F.when(stacked, "stacked layout (fraction, root or stacked index) flattened in drawing order")
        .when(c.rlike(DANGLING), "operators with nothing to operate on — terms are out of order")
        .when((F.size(indices) > F.size(F.array_distinct(indices))) & pieces, "subscripts printed apart from their symbols")
        .when(pieces & (n >= 10), "mostly one- and two-character fragments")
    )


def flattened_table(c: Column) -> Column:
    """The name of a table whose values stand in one line: the last caption before twelve values in a row, else the first one; null without such a run."""
    t = tokens(c)
    flags = F.array_join(F.transform(t, lambda x: F.when(x.rlike(TABLE_VALUE), "v").otherwise(".")), "")
    at = F.instr(flags, "v" * TABLE_RUN) - 1
    before = F.regexp_extract_all(F.array_join(F.slice(t, 1, F.greatest(at, F.lit(0))), " "), F.lit(TABLE_NAME), 0)
    anywhere = F.nullif(F.regexp_extract(c, TABLE_NAME, 0), F.lit(""))
    return F.when(at >= 0, F.coalesce(F.try_element_at(before, F.lit(-1)), anywhere, F.lit("unnamed table")))


def occurrence_id(slug: str, within: str, order: str) -> Column:
    """x, x-2, x-3: ids made unique within a document, in order."""
    n = F.row_number().over(W.partitionBy(within, slug).orderBy(order))
    return F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string")))
