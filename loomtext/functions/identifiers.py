"""Identifiers of texts and references: canonical forms, bare numbers, volumes, sort keys, terms in glosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .titles import MARKED



def canonical_id(text: Column) -> Column:
    """``T1n250``, ``T01n0250`` and the like as volume of two and number of four digits, letter kept; null if neither."""
    parts = [F.regexp_extract(text, r"^T0*(\d+)n0*(\d+)([A-Za-z]?)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat(F.lit("T"), F.lpad(parts[0], 2, "0"), F.lit("n"), F.lpad(parts[1], 4, "0"), parts[2]))


def bare_number(text: Column) -> Column:
    """The number of ``T250``, ``T0250``, ``T08n0250`` or ``250``; null where there is none."""
    digits = F.regexp_extract(text, r"^(?:T\d+n|T)?0*(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def volume(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^T(\d{2})n\d{4}", 1)
    return F.when(digits != "", digits.cast("int"))


def text_number(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^T\d{2}n(\d{4})", 1)
    return F.when(digits != "", digits.cast("int"))


def catalogue_id(text: Column) -> Column:
    """``T1``, ``1``, ``T2917A`` as ``T0001``, ``T2917a``; anything else as it is."""
    number, letters = (F.regexp_extract(text, r"^T?0*(\d+)([A-Za-z]*)$", i) for i in (1, 2))
    return F.when(number == "", text).otherwise(F.concat(F.lit("T"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number), F.lower(letters)))


def id_in_volume(text: Column, volume_: Column) -> Column:
    """``T250`` in volume ``T08`` as ``T08n0250``, letters kept; without a volume, or if it is no number, as it is."""
    number, letters = (F.regexp_extract(text, r"^T(\d+)([A-Za-z]*)", i) for i in (1, 2))
    known = volume_.startswith("T") & (number != "")
    return F.when(known, F.concat(volume_, F.lit("n"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number), letters)).otherwise(text)


def dictionary_id(link: Column) -> Column:
    """The entry of a dictionary link: what precedes its query, and quotes, go."""
    return F.regexp_replace(F.regexp_replace(link, r".*/xpr-ddb\.pl\?", ""), "['\"]", "")


def resolved(raw: DataFrame, texts: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``text_id``: the corpus id that a reference names.

    A bare number is the smallest id with that number; a canonical id is itself if the corpus has it, else without its
    letters if the corpus has that, else itself; anything else is null. ``texts`` has one column, text_id.
    """
    known = texts.select("text_id").distinct()
    smallest = known.withColumn("_n", text_number(F.col("text_id"))).where("_n is not null").groupBy("_n").agg(F.min("text_id").alias("_by_number"))
    name = F.trim(column)
    canonical = F.coalesce(canonical_id(name), F.when(name.rlike(r"^T\d{2}n\d{4}"), name))
    number = F.when(canonical.isNull() & name.rlike(r"^T?\d+[A-Za-z]?$"), bare_number(name))
    out = raw.withColumns({"_c": canonical, "_n": number}).withColumn("_b", F.regexp_replace("_c", "[A-Za-z]+$", ""))
    out = out.join(smallest, "_n", "left")
    for key, mark in (("_c", "_whole"), ("_b", "_base")):
        out = out.join(known.select(F.col("text_id").alias(key), F.col("text_id").alias(mark)), key, "left")
    return out.withColumn("text_id", F.coalesce("_by_number", "_whole", "_base", "_c")).drop("_n", "_c", "_b", "_by_number", "_whole", "_base")


def without_suffix(text: Column) -> Column:
    """``T0310-7`` and ``T0310_a`` as ``T0310``."""
    return F.regexp_replace(text, r"[-_].*$", "")


def with_volume(numbers: DataFrame, ranges: DataFrame, number: str = "number") -> DataFrame:
    """Adds ``volume`` from (volume, low, high), a few fixed ranges; 0 where none holds the number."""
    joined = numbers.join(F.broadcast(ranges), F.col(number).between(F.col("low"), F.col("high")), "left")
    return joined.withColumn("volume", F.coalesce("volume", F.lit(0))).drop("low", "high")


def toh_numbers(keys: Column) -> Column:
    """Catalogue numbers of keys such as ``toh251, toh12a``."""
    return F.array_distinct(F.regexp_extract_all(keys, F.lit(r"toh(\d+[a-z]?)"), F.lit(1)))


def toh_label(number: Column) -> Column:
    """``Toh N``; a negative number is a catalogue row without one."""
    return F.when(number < 0, F.concat(F.lit("CBETA-Tib "), F.abs(number).cast("string"))).otherwise(F.concat(F.lit("Toh "), number.cast("string")))


def sort_key(ref: Column) -> Column:
    """(number, letter, part) of ``7``, ``7a`` and ``760,01``: orders references as people do."""
    part = F.regexp_extract(ref, r",(\d+)$", 1)
    return F.struct(
        F.coalesce(F.try_to_number(F.regexp_extract(ref, r"(\d+)", 1), F.lit("9999999999")).cast("int"), F.lit(-1)).alias("number"),
        F.regexp_extract(ref, r"\d([a-z])", 1).alias("letter"),
        F.when(part == "", 0).otherwise(F.coalesce(F.try_to_number(part, F.lit("9999999999")).cast("int"), F.lit(0))).alias("part"),
    )


def sanskrit_term(gloss: Column) -> Column:
    """The first word of ``(Skt. *x ...)``, else the first word with an Indic mark; null if there is neither."""
    given = F.regexp_extract(gloss, r"\(Skt\.?\s*\*?([^\s;,)]+)", 1)
    marked = F.regexp_extract(gloss, rf"([A-Za-z{MARKED}]*[{MARKED}][A-Za-z{MARKED}]*)", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(marked, F.lit("")))
