"""Fields of stored HTML pages by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(page: Column, pattern: str) -> Column:
    """The first match of the pattern's group, empty if there is none."""
    return F.regexp_extract(page, pattern, 1)


def all_fields(page: Column, pattern: str) -> Column:
    return F.regexp_extract_all(page, F.lit(pattern), F.lit(1))


def no_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def labelled_cell(page: Column, label: str) -> Column:
    """The cell beside a label in a table, tags off: ``<td>label</td><td>value</td>`` or th for the label."""
    return F.trim(no_tags(F.regexp_extract(page, rf"(?is)<t[hd][^>]*>\s*{label}\s*</t[hd]>\s*<td[^>]*>(.*?)</td>", 1)))
