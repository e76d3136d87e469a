"""Column functions on titles: normal forms, tokens, similarity ratios, the title score of ideographic titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK_TITLE, keep_only

# Romanised letters with marks and their plain forms.
MARKED = "āīūṛṝḷḹṃṁṅñṇṭḍśṣḥĀĪŪṚṜḶḸṂṀṄÑṆṬḌŚṢḤ"
PLAIN = "aiurrllmmnnntdsshAIURRLLMMNNNTDSSH"
HIDDEN = "­​‌‍﻿"


#: What separates the words of a title: dashes, dots, spaces, brackets and the like; other signs are letters of it.
SEPARATORS = r"(?U)[-–—.\s()\[\]{},;:/'\"*?!]+"


def decoded(title: Column) -> Column:
    """Entities of HTML as characters, by an Arrow function; for catalogue tables, which are small."""

    @F.pandas_udf("string")
    def unescaped(titles):  # noqa: ANN001, ANN202
        import html

        return titles.map(lambda t: html.unescape(t) if t and "&" in t else t)

    return unescaped(title)


def _plain(title: Column) -> Column:
    return F.lower(F.translate(F.translate(title, HIDDEN, ""), MARKED, PLAIN))


def normal_title(title: Column) -> Column:
    """Hidden characters and marks off, lower case, all separators off: one word."""
    return F.regexp_replace(_plain(title), SEPARATORS, "")


def title_tokens(title: Column) -> Column:
    """Distinct words of two or more characters of a title as it is given."""
    return F.array_distinct(F.filter(F.split(_plain(title), SEPARATORS), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def most_edits(a: Column, b: Column, ratio: float) -> Column:
    """Edits that a pair may have; the product is taken in doubles and cut, so 20 * (1 - 0.9) gives 1."""
    return (F.greatest(F.length(a), F.length(b)) * F.lit(1 - ratio)).cast("int")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def strip_prefixes(title: Column, prefixes: tuple[str, ...]) -> Column:
    """Prefixes off in order, each only if more than one character stays."""
    for p in prefixes:
        title = F.when(title.startswith(p) & (F.length(title) - len(p) > 1), F.substring(title, F.lit(len(p) + 1), F.length(title))).otherwise(title)
    return title


def _letters(alphabet: str) -> str | None:
    """The characters of a class of ASCII letters, digits and their ranges, if they are no more than bits of a long."""
    if not re.fullmatch(r"(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+", alphabet):
        return None
    spans = [x.split("-") for x in re.findall(r".-.|.", alphabet)]
    found = "".join(dict.fromkeys(chr(c) for x in spans for c in range(ord(x[0]), ord(x[-1]) + 1)))
    return found if len(found) <= 63 else None


def title_parts(title: Column, prefixes: tuple[str, ...], alphabet: str = CJK_TITLE) -> Column:
    """What :func:`parts_score` compares of a title, to be made once for a title that is in many pairs.

    own: its characters of ``alphabet``; bare: those without prefixes; part: bare unless empty; set: the distinct ones of
    part, bits of a long for a small alphabet, else an array.
    """
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  a name for a value that is used often
    letters = _letters(alphabet)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("instr", F.lit(letters), c) - 1)
    marks = lambda x: F.array_distinct(F.split(x, "")) if letters is None else F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))
    first = once(F.struct(keep_only(title, alphabet).alias("own"), keep_only(strip_prefixes(title, prefixes), alphabet).alias("bare")), lambda t: F.struct(t["own"].alias("own"), t["bare"].alias("bare"), F.when(t["bare"] != "", t["bare"]).otherwise(t["own"]).alias("part")))
    return once(first, lambda t: F.struct(t["own"].alias("own"), t["bare"].alias("bare"), t["part"].alias("part"), marks(t["part"]).alias("set")))


def bits_jaccard(a: Column, b: Column) -> Column:
    """:func:`jaccard` of sets that are bits of a long."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / either)


def parts_score(u: Column, v: Column, share: Column) -> Column:
    """The score of two titles by their :func:`title_parts` and the Jaccard of their sets."""
    x, y, short = u["part"], v["part"], F.least(F.length(u["part"]), F.length(v["part"]))
    return (
        F.when((u["own"] == "") | (v["own"] == ""), F.lit(0.0)).when(u["own"] == v["own"], F.lit(1.0)).when((u["bare"] != "") & (u["bare"] == v["bare"]), F.lit(0.95))
        .when((short >= 2) & (x.contains(y) | y.contains(x)), F.lit(0.90))
        .when((short <= 3) & (share >= 0.7), share).when((short > 3) & (share >= 0.4), share).otherwise(F.lit(0.0))
    )


def title_score(a: Column, b: Column, prefixes: tuple[str, ...], alphabet: str = CJK_TITLE) -> Column:
    """1 equal, .95 equal without prefixes, .90 one within the other, else the share of characters if high enough.

    Only characters of ``alphabet`` count; a title without any scores 0. Prefixes go before the others do.
    """
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    alike = jaccard if _letters(alphabet) is None else bits_jaccard
    first = once(F.struct(title_parts(a, prefixes, alphabet).alias("u"), title_parts(b, prefixes, alphabet).alias("v")), lambda t: F.struct(t["u"].alias("u"), t["v"].alias("v"), alike(t["u"]["set"], t["v"]["set"]).alias("share")))
    return once(first, lambda t: parts_score(t["u"], t["v"], t["share"]))
