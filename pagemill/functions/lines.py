"""Predicates of single lines; the patterns hold for Java and RE2 alike, so that queries and their SQL share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as which kind of line.
LEADER = r"\.( ?\.){3}|\.{2,} ?[0-9]{1,4}$"
ENTRY = r"[A-Za-z]{3}.*[^0-9][0-9]{1,4}$"
PAGE_NUMBER = r"^(?i:[0-9]{1,4}|[ivxlcdm]{1,7}|page [0-9]+|p\. ?[0-9]+)$"
CAPTION = r"^(Figure|Fig\.|Table) ([A-Z]{0,2}\.?[0-9]{1,2}(?:\.[0-9]+)?[a-z]?) ?[–—:-]"
BLOCK = r"^(?:[•●▪◦*–-] |\([a-z0-9]{1,3}\) |[0-9]{1,2}[.)] |[0-9]{1,2}\.[0-9]|[A-Z](?:\.[0-9]+)+ [A-Z])"
HEADING = r"^[0-9]{1,2}(?:\.[0-9]{1,3}){0,5} [A-Z]"
PROSE_WORD = r"(?:^|[^A-Za-z])[a-z]{4,}"
LICENCE = r"(?i:Licensee=|Licensed cop(?:y|ies)|Uncontrolled Copy|Not for Resale|No reproduction or networking permitted|Provided by.{0,80}under licen[cs]e).*$"
SENTENCE_LIKE = r":| (?:according to|in accordance with|as given in|as defined in|as specified in|shall|should|may be|is the|are the|of the) "

NOISE = r"^(?:EN\s|BS\s|ISO\s|prEN\s|Sect\.|Page\s|©|Copyright|Provided by|Licensee|No reproduction|Not for Resale|American Institute)"
DANGLING = ("or", "and", "to", "the", "of", "a", "an", "in", "with", "for", "as", "by", "on")
STARTERS = ("For", "Where", "When", "If", "This", "The", "These", "It")
NUMBERED = r"^([0-9]{1,2}(?:\.[0-9]{1,3}){0,5})\s+(\p{Lu}.{1,120})$"
ANNEX = r"^Annex\s+(N\.?A\.?|Z?[A-Z])\s*$"
ANNEX_CLAUSE = r"^((?:N\.?A\.?|Z?[A-Z])(?:\.[0-9]{1,3}){1,4})\s+(\p{Lu}.{1,120})$"
BODY_HEADING = r"^((?:[0-9]{1,2}|[A-Z])(?:\.[0-9]{1,3})+)\.?\s+\p{Lu}"
REGION_CAPTION = r"^(Table|Figure)\s+([A-Z]{0,2}\.?[0-9]{1,3}(?:\.[0-9]{1,3})*[a-z]?)\.?(?:\s*[—–:-]\s*|\s+)[\p{Lu}(]"
FORMULA_NEIGHBOUR = r"^(?:where|with|for|in which|and|or|if|but|see|NOTE)\b|^\([0-9]{1,3}\)\s|^[0-9]+(?:\.[0-9]+)+\.?\s+\p{Lu}"
EXERCISE = r"(?i: is subjected | is loaded | determine the | calculate the | shown (?:below|in fig) | as shown )"


def has_heading_length(line: Column) -> Column:
    return F.length(line).between(3, 150)


def is_noise(line: Column) -> Column:
    """Running headers, footers and notices that a number may follow."""
    return line.rlike(NOISE)


def is_chapter_title(title: Column) -> Column:
    """What may follow a number without a dot: a short title, not running text or a cut-off cell."""
    words = F.filter(F.split(title, " ", -1), lambda w: w != "")
    brackets = F.regexp_count(title, F.lit("\\(")) == F.regexp_count(title, F.lit("\\)"))
    plain = (F.length(title) >= 4) & ~title.rlike("\\.$") & ~title.rlike("[0-9]") & brackets & F.size(words).between(1, 12)
    return plain & ~F.lower(F.element_at(words, -1)).isin(*DANGLING) & ~F.element_at(words, 1).isin(*STARTERS)


def is_region_caption(line: Column) -> Column:
    return line.rlike(REGION_CAPTION) & (F.length(line) <= 200)


def is_beside_formula(line: Column) -> Column:
    """Running text, a caption or a heading: what a displayed formula ends at."""
    return is_prose(line) | line.rlike(FORMULA_NEIGHBOUR) | line.rlike(REGION_CAPTION)


def printed_heading(line: Column) -> Column:
    """The line as a heading, without a page number at its end; null if it is a sentence or too long."""
    number = F.regexp_extract(line, BODY_HEADING, 1)
    words = F.ltrim(F.substring(line, F.when(number == "", F.lit(1)).otherwise(F.length(number) + 2), F.lit(1 << 20)), F.lit(". "))
    sentence = words.rlike(r"[.!?;:]\s")
    fits = F.length(line).between(1, 120) & ~line.rlike("\\.$") & ~sentence
    return F.when(fits, F.when(line.rlike(r"\p{L}[^0-9]*\s[0-9]{1,4}$"), F.regexp_replace(line, r"\s+[0-9]{1,4}$", "")).otherwise(line))


def is_standalone_heading(line: Column) -> Column:
    """A numbered line that is a heading by itself, with a word of three letters or more."""
    rest = F.substring(line, F.length(F.regexp_extract(line, BODY_HEADING, 1)) + 1, F.lit(1 << 20))
    return line.rlike(BODY_HEADING) & printed_heading(line).isNotNull() & rest.rlike(r"\p{L}{3}")


def is_entry(line: Column) -> Column:
    """A contents entry: a word of three letters, and a number of up to four digits at the end (:data:`ENTRY`, in linear time)."""
    head = F.rtrim(line, F.lit("0123456789"))
    digits = F.length(line) - F.length(head)
    return (digits >= 1) & (digits <= 4) & F.substring(head, F.lit(1), F.length(head) - 1).rlike("[A-Za-z]{3}")


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_block_start(line: Column) -> Column:
    return line.rlike(BLOCK)


def is_caption(line: Column) -> Column:
    return line.rlike(CAPTION)


def is_prose(line: Column) -> Column:
    return F.regexp_count(line, F.lit(PROSE_WORD)) >= 2


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING) & (F.length(line) < 70) & ~line.rlike(r"\.$")


def is_sentence_like(title: Column) -> Column:
    return F.concat(F.lit(" "), title, F.lit(" ")).rlike(SENTENCE_LIKE) | (title.rlike(r"\.$") & (F.length(title) > 25))


def without_licence(line: Column) -> Column:
    return F.rtrim(F.regexp_replace(line, LICENCE, ""), F.lit(" ,;–-"))
