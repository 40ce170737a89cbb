"""Facts on files' bytes and tags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.functions.names import col


def has_bom(content: Column | str) -> Column:
    """Whether binary content starts with the UTF-8 byte order mark."""
    return F.coalesce(F.startswith(col(content), F.lit(b"\xef\xbb\xbf")), F.lit(False))


def is_utf8(content: Column | str) -> Column:
    return F.coalesce(F.is_valid_utf8(col(content).cast("string")), F.lit(True))


def line_of(text: Column | str, position: Column) -> Column:
    """The line, from 1, of a character position, from 1; null for position 0."""
    before = F.substr(col(text), F.lit(1), position - 1)
    return F.when(position > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def first_match_line(text: Column | str, pattern: str) -> Column:
    """The line of the pattern's first match, null without one."""
    return line_of(text, F.regexp_instr(col(text), F.lit(pattern)))
