"""Words and white space as every operator here understands them: words are ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda's variable is bound, while a nested column expression may be inlined into loops."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of a text's words; empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))


def count_of(text: Column, characters: str) -> Column:
    """How many of a text's code points are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))
