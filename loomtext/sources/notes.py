"""Notes and stored pages of catalogues: numbers, dynasties and cross references within short texts, and field tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .references import field_numbers

# Dynasties that end a note, and labels of the fields of stored pages.
DYNASTIES = "後漢|三國|西晉|東晉|前秦|後秦|姚秦|北涼|劉宋|蕭齊|梁|陳|北魏|北齊|隋|唐|宋|五代|元|明|清|高麗|新羅|日本"
CF_END = "[東西南北後前劉宋唐秦晉隋梁陳]"
TOHOKU_FIELD, OTANI_FIELD, OTHER_FIELD = "東北大學藏經目錄", "西藏大藏經甘殊爾勘同目錄", "其他目錄"
TITLE_FIELD, AUTHORITY_FIELD, GORYEO = "經名：", "規範碼：", "高麗藏經目錄"


def _numbers(note: Column, label: str) -> Column:
    return F.regexp_extract_all(note, F.lit(rf"{label}\.\s*(\d+)"), F.lit(1)).cast("array<int>")


def nanjio_numbers(note: Column) -> Column:
    return _numbers(note, "Nj")


def korean_numbers(note: Column) -> Column:
    return _numbers(note, "K")


def compared_numbers(note: Column) -> Column:
    """Numbers and ranges after ``Cf.``, brackets left out, up to a dynasty or a page number at the end."""
    listed = F.regexp_extract(note, rf"Cf\.\s*(.+?)(?:\s*{CF_END}|\s*\d{{1,2}}\s*$)", 1)
    parts = F.transform(F.split(F.regexp_replace(listed, r"\([^)]*\)", ""), ","), lambda x: F.trim(x))
    number = lambda x, i: F.try_to_number(F.regexp_extract(x, r"^(\d+)\s*-\s*(\d+)", i), F.lit("9999999999")).cast("long")
    single = lambda x: F.when(x.rlike(r"^\d+$"), F.array(x.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = lambda x: F.when(number(x, 1) <= number(x, 2), F.sequence(number(x, 1), number(x, 2))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+\s*-\s*\d+"), spread(x)).otherwise(single(x))))


def dynasty(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, rf"({DYNASTIES})\s*\d*\s*$", 1), F.lit(""))


def page_number(note: Column) -> Column:
    """The page of the printed catalogue, which stands after the dynasty."""
    return F.nullif(F.regexp_extract(note, rf"(?:{DYNASTIES})\s*(\d+)\s*$", 1), F.lit("")).cast("int")


def indirect_links(persons: DataFrame) -> DataFrame:
    """(person_id, texts, refs) of persons with texts (works or attributions) and references; both sorted, each once."""
    none = F.array().cast("array<string>")
    texts = F.array_sort(F.array_union(F.coalesce("works", none), F.coalesce("attributions", none)))
    refs = F.array_sort(F.array_distinct(F.coalesce("refs", none)))
    return persons.select("person_id", texts.alias("texts"), refs.alias("refs")).where((F.size("texts") > 0) & (F.size("refs") > 0))


def otani_numbers(field: Column) -> Column:
    """``Otani N`` or ``Otani N(part)`` of a field such as ``O. 750, 760(5).``; none where it only says to see below."""
    found = F.regexp_extract_all(field, F.lit(r"(\d+(?:\([^)]+\))?)"), F.lit(1))
    return F.when(F.lower(field).contains("see below") | field.isNull(), F.array().cast("array<string>")).otherwise(F.transform(found, lambda x: F.concat(F.lit("Otani "), x)))


def catalogue_page(pages: DataFrame, cap: int | None = 200) -> DataFrame:
    """(text_id, authority, title, goryeo, refs: array of (number, secondary), otani) of (text_id, html), if any number is there.

    Fields are cells after their labels; where both number fields are empty, the field of other catalogues is read.
    """
    cell = lambda label: F.trim(F.regexp_extract("html", rf"{label}</div><div>(.*?)</div>", 1))
    other = cell(OTHER_FIELD)
    toh, otani = cell(TOHOKU_FIELD), cell(OTANI_FIELD)
    none = (toh == "") & (otani == "")
    toh = F.when(none, F.regexp_extract(other, r"To\.\s*([\d,\s.\-()]+?)(?:;|$)", 1)).otherwise(toh)
    otani = F.when(none, F.regexp_extract(other, r"(?<![A-Za-z])O\.\s*([\d,\s.()]+?)(?:;|$)", 1)).otherwise(otani)
    out = pages.select(
        "text_id", F.nullif(F.regexp_extract("html", rf"{AUTHORITY_FIELD}</span>(CA\d+)", 1), F.lit("")).alias("authority"), F.nullif(F.trim(F.regexp_extract("html", rf"{TITLE_FIELD}</span>(.+?)</div>", 1)), F.lit("")).alias("title"),
        F.col("html").contains(GORYEO).alias("goryeo"), field_numbers(toh, "To", cap).alias("refs"), otani_numbers(otani).alias("otani"),
    )
    return out.where(F.size("refs") > 0)


def primary_first(pages: DataFrame) -> DataFrame:
    """(text_id, toh, status): each number of each page once, primary where it stands outside brackets anywhere."""
    each = pages.select("text_id", F.explode("refs").alias("r")).select("text_id", F.col("r.number").alias("toh"), F.col("r.secondary").alias("secondary"))
    return each.groupBy("text_id", "toh").agg(F.when(F.min("secondary"), "secondary").otherwise("primary").alias("status"))


def dictionary_matches(matches: DataFrame) -> DataFrame:
    """(taisho, titles, methods) of (taisho, tibetan_title, method, rank): of several for one title the first method by rank counts."""
    once = matches.groupBy("taisho", "tibetan_title").agg(F.min_by("method", F.struct("rank", "method")).alias("method"))
    return once.groupBy("taisho").agg(F.array_sort(F.collect_list("tibetan_title")).alias("titles"), F.array_sort(F.collect_set("method")).alias("methods"))


def nanjio_map(crossrefs: DataFrame, sanskrit: DataFrame) -> DataFrame:
    """(nanjio, taisho) from (nanjio, taisho) and (nanjio, taisho: array): both catalogues, each pair once."""
    named = lambda c: F.when(c.startswith("Nj"), c).otherwise(F.concat(F.lit("Nj "), c))
    left = crossrefs.where("nanjio is not null and taisho is not null").select(named(F.col("nanjio")).alias("nanjio"), F.regexp_replace("taisho", "^T", "").alias("taisho"))
    right = sanskrit.where("nanjio is not null").select(named(F.col("nanjio")).alias("nanjio"), F.explode("taisho").alias("t")).select("nanjio", F.regexp_replace("t", "^T", "").alias("taisho"))
    return left.unionByName(right).distinct()
