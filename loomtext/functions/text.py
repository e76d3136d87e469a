"""Column functions on texts: normalisation, words, grams, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges that the corpus normaliser, the phonetic test and the title test keep.
CJK_CORPUS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
CJK_PHONETIC = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}"
CJK_TITLE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
#: The alphabet of Latin-script corpora.
LATIN = r"\p{L}\p{N}"


def keep_only(text: Column, alphabet: str = CJK_CORPUS) -> Column:
    """The text without any character outside ``alphabet`` (the inside of a regular-expression class)."""
    return F.regexp_replace(text, f"[^{alphabet}]", "")


def has_only(text: Column, alphabet: str = CJK_PHONETIC) -> Column:
    """Whether a text is not empty and has no character outside ``alphabet``."""
    return text.rlike(f"^[{alphabet}]+$")


def ends(text: Column, n: int = 200) -> Column:
    """(opening, closing) of a text: its first and last ``n`` characters; a shorter text is both."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.left(text, F.lit(n)).alias("opening"), F.right(text, F.lit(n)).alias("closing"))


def spaced(text: Column) -> Column:
    """Lower-cased runs of letters and digits with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{LATIN}]+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a text without any has none."""
    plain = spaced(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def characters(text: Column) -> Column:
    """Code points of a text; an empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def grams(tokens: Column, n: int, glue: str = " ") -> Column:
    """Overlapping n-grams in order, repeats included; none where there are fewer than n tokens."""
    last = F.size(tokens) - n
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), glue))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def stable_hash(text: Column) -> Column:
    return F.crc32(text.cast("binary"))
