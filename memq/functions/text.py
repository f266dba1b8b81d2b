"""Normal forms of text: words, values, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace in the sense of Unicode, with the four separator controls.
BLANK = r"[\s\x0B\x1c-\x1f\x85\xa0  -     　]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced_words(c: Column | str) -> Column:
    """The words of a text (runs of letters and digits, lower-cased) joined by one blank; null stays null."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), NOT_WORD, " "))


def words(c: Column | str) -> Column:
    """The words as an array; empty for a text without words, null for null."""
    return F.filter(F.split(spaced_words(c), " "), lambda w: w != "")


def fields(c: Column | str) -> Column:
    """The fields of an object: the pieces between ; and |, each as its words, sorted, without empty ones."""
    pieces = F.transform(F.split(F.lower(_c(c)), "[;|]"), lambda p: F.trim(F.regexp_replace(p, NOT_WORD, " ")))
    return F.array_sort(F.filter(pieces, lambda p: p != ""))


def value(c: Column | str) -> Column:
    """The normal form of an object, one string; null where the object is null or has no words.

    Neither the order of fields nor empty pieces matter.
    """
    return F.when(has_words(c), F.when(_c(c).rlike("[;|]"), F.array_join(fields(c), ";")).otherwise(spaced_words(c)))


def has_words(c: Column | str) -> Column:
    """Whether a text has any letter or digit; a filter on this costs less than one on the normal form."""
    return _c(c).rlike(r"[\p{L}\p{N}]")


def entity(c: Column | str) -> Column:
    """Lower-cased, each run of whitespace one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), BLANK, " "))


def strip(c: Column | str) -> Column:
    """Without the whitespace at both ends."""
    return F.regexp_replace(_c(c), f"^{BLANK}|{BLANK}$", "")
