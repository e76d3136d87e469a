"""Grammars of reference fields: numbers and ranges in brackets, primary and secondary references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(part: Column, cap: int | None = None) -> Column:
    """The numbers of ``a-b`` or ``a``; none where b is below a or beyond ``cap`` numbers."""
    a = F.try_to_number(F.regexp_extract(part, r"^(\d+)", 1), F.lit("9999999999")).cast("long")
    b = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(part, r"-(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("long"), a)
    good = (b >= a) if cap is None else (b >= a) & (b - a <= cap)
    return F.when(good, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a catalogue note: the leading ``No. N`` and the numbers and ranges of its first brackets."""
    inside = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    listed = F.flatten(F.transform(F.regexp_extract_all(inside, F.lit(r"(\d+(?:-\d+)?)"), F.lit(1)), lambda x: _range(x)))
    own = F.regexp_extract(text, r"^No\. (\d+)", 1)
    return F.array_distinct(F.concat(F.when(own != "", F.array(F.try_to_number(own, F.lit("9999999999")).cast("long"))).otherwise(F.array().cast("array<bigint>")), listed))


def field_numbers(field: Column, prefix: str, cap: int | None = 200) -> Column:
    """(number, secondary) of a field such as ``To. 45-93, (100, 7), n3 556``: footnote marks go, brackets hold secondary ones.

    A range spans fewer than ``cap`` numbers, as the original results have it; None takes every range. A longer range
    gives its two ends.
    """
    body = F.regexp_replace(F.coalesce(field, F.lit("")), rf"^\s*{prefix}\.?\s*", "")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    inside = F.array_distinct(F.flatten(F.transform(found(body, r"\(([^)]+)\)"), lambda x: found(x, r"(\d+)"))))
    outside = F.regexp_replace(F.regexp_replace(body, r"\([^)]*\)", ""), r"\bn\d+\b", "")
    least = lambda x: F.try_to_number(F.regexp_extract(x, r"^(\d+)", 1), F.lit("9999999999")).cast("long")
    most = lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"-\s*(\d+)$", 1), F.lit("")), F.lit("9999999999")).cast("long"), least(x))
    fits = lambda x: (most(x) >= least(x)) & ((most(x) - least(x) < cap) if cap is not None else F.lit(True))
    own = F.array_distinct(F.flatten(F.transform(found(outside, r"(\d+(?:\s*-\s*\d+)?)"), lambda x: F.when(fits(x), F.sequence(least(x), F.greatest(least(x), most(x)))).otherwise(F.array(least(x), most(x))))))
    mark = lambda numbers, secondary: F.transform(numbers, lambda n: F.struct(n.cast("long").alias("number"), F.lit(secondary).alias("secondary")))
    return F.concat(mark(own, False), mark(inside, True))
