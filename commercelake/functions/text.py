"""Text expressions. The scans they serve read whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"


def strip(col: Column) -> Column:
    """Drop white space at both ends (plain trim drops spaces only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]+>", "")


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def line_count(col: Column) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def replace_first(col: Column, pattern: str) -> Column:
    """Delete only the first match of a pattern (Spark's replace deletes all)."""
    return F.regexp_replace(col, rf"(?s)\A(.*?){pattern}", "$1")


def file_header(col: Column) -> Column:
    """File name of the first '# FILE: name' line anywhere in the text, or ''."""
    return strip(F.regexp_extract(col, r"(?m)^# FILE: (.+)", 1))
