"""Column expressions for the word and line rules that the operators share.

A word is a run of characters other than blank and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word with the blanks behind it becomes one character."""
    shrunk = F.regexp_replace(F.coalesce(text, F.lit("")), WORD + r"[\x20\x09-\x0D]*", "x")
    return F.length(F.ltrim(shrunk, F.lit(BLANKS))).cast("long")


def words_of(text: Column) -> Column:
    """The words as an array, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)
