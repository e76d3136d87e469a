"""Catalogue sources: collection XML, JSON groups of parallels, citations, per-file TSV statistics, embedded references."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Prefixes of Pali references and of the Chinese Agamas.
PALI = (
    "dn", "mn", "sn", "an", "dhp", "snp", "ud", "iti", "thag", "thig", "ja", "kp", "pv", "vv", "cp", "cnd", "mnd", "tha-ap", "thi-ap",
    "mil", "ne", "pe", "ds", "vb", "dt", "pp", "kv", "ya", "patthana", "pli-tv",
)
AGAMAS = ("da", "ma", "sa-3", "sa-2", "sa", "ea-2", "ea")
# Patterns of catalogue files.
ITEM = r"(?s)<item>(.*?)</item>"
TAISHO_LINK = r"<cmp><ref>(T\d+(?:-\d+)?)</ref><type>translation-taisho</type></cmp>"


def json_or_empty(spark: SparkSession, path: str, schema: str, warn: bool = False) -> DataFrame:
    """Rows of a JSON file; a missing or damaged file has none, with a warning if ``warn``."""
    try:
        df = spark.read.schema(f"{schema}, _damaged string").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path)
        rows = df.where("_damaged is null").drop("_damaged")
        if warn and any(r["_damaged"] is not None for r in df.limit(1).collect()):
            warnings.warn(f"{path} is no JSON", stacklevel=2)
        return rows
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if warn:
            warnings.warn(f"{path} is missing", stacklevel=2)
        return spark.createDataFrame([], schema)


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text) of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.decode("content", "utf-8").alias("text"))


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.regexp_extract_all("text", F.lit(ITEM), F.lit(1))).alias("item"))


def _tag(name: str) -> Column:
    """Trimmed text of the first such element of an item, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract("item", rf"<{name}>([^<]+)", 1)), F.lit(""))


def collection_items(rows: DataFrame, letter: str = "DQ", kernel_tag: str = "rkts") -> DataFrame:
    """(kernel, ref, tibetan, sanskrit): the first number of each item of a collection's XML, by kernel id.

    ``letter``: the letters of editions that count. A kernel id must be digits only; of a kernel's items with one number
    the one whose titles come first in code-point order stays.
    """
    kernel = F.regexp_extract("item", rf"<{kernel_tag}>(\d+)</{kernel_tag}>", 1)
    ref = F.regexp_extract("item", rf"<ref>[{letter}](\d+(?:[a-z]|,\d+)?)</ref>", 1)
    whole = lambda name: F.trim(F.regexp_extract("item", rf"(?s)<{name}>(.*?)</{name}>", 1))
    sanskrit = F.when(whole("skttrans") != "", whole("skttrans")).otherwise(whole("sanskrit"))
    each = _items(rows).select(kernel.alias("kernel"), ref.alias("ref"), F.struct(whole("tib").alias("tibetan"), sanskrit.alias("sanskrit")).alias("t")).where("kernel <> '' and ref <> ''")
    return each.groupBy("kernel", "ref").agg(F.min("t").alias("t")).select("kernel", "ref", "t.*")


def derge_numbers(rows: DataFrame) -> DataFrame:
    """(rkts, toh) of (seq, text): numbers that follow a kernel id at once; of several the last counts."""
    pair = r"<rkts>([^<]+)</rkts>\s*<ref>D(\d+)</ref>"
    ids, numbers = (F.regexp_extract_all("text", F.lit(pair), F.lit(i)) for i in (1, 2))
    each = rows.select("seq", F.posexplode(F.arrays_zip(ids.alias("id"), numbers.alias("n"))).alias("at", "p"))
    return each.groupBy(F.trim("p.id").alias("rkts")).agg(F.max_by(F.col("p.n").cast("int"), F.struct("seq", "at")).alias("toh"))


def kernel_links(rows: DataFrame, derge: DataFrame) -> DataFrame:
    """(rkts, toh, taisho, section, tibetan, sanskrit, english) of kernel items that are linked to Taisho texts.

    ``T0310-7`` counts as T310; an item without such a link is left out; the number is null where the edition lacks it.
    """
    links = F.regexp_extract_all("item", F.lit(TAISHO_LINK), F.lit(1))
    taisho = F.array_distinct(F.transform(links, lambda t: F.concat(F.lit("T"), F.regexp_extract(t, r"T0*(\d+)", 1))))
    tags = {"section": "section", "tibetan": "StandardTibetan", "sanskrit": "StandardSanskrit", "english": "English84000"}
    own = _items(rows).select(_tag("rkts").alias("rkts"), taisho.alias("taisho"), *(_tag(t).alias(c) for c, t in tags.items()))
    return own.where((F.size("taisho") > 0) & F.col("rkts").isNotNull()).join(derge, "rkts", "left").select("rkts", "toh", "taisho", *tags)


def classify_reference(ref: Column) -> Column:
    """agama, taisho, pali or other of a reference; a leading ~ and a section after # are left aside.

    A Pali prefix must be the whole reference or stand before a digit, a full stop or a hyphen; that of the monastic
    rules may stand before anything.
    """
    name = F.regexp_replace(F.regexp_replace(ref, "^~+", ""), "#.*$", "")
    agama = r"^(" + "|".join(AGAMAS) + r")\.?\d"
    pali = r"^(?:" + "|".join(sorted((p for p in PALI if p != "pli-tv"), key=len, reverse=True)) + r")(?:$|[\d.\-])|^pli-tv"
    return F.when(name.rlike(agama), "agama").when(name.rlike(r"^t\d"), "taisho").when(name.rlike(pali), "pali").otherwise("other")


def agama_of(ref: Column) -> Column:
    """The collection of an Agama reference, null for others."""
    return F.nullif(F.regexp_extract(F.regexp_replace(ref, "^~+", ""), r"^(" + "|".join(AGAMAS) + r")\.?\d", 1), F.lit(""))


def parallel_groups(groups: DataFrame) -> DataFrame:
    """(chinese, pali, full, agamas, times) from (refs: array): all pairs within each group; a leading ~ marks a partial one.

    ``full``: some group has both without the mark; ``agamas``: the Agama references that led to a collection.
    """
    own = groups.select(F.monotonically_increasing_id().alias("g"), "refs")
    side = lambda kinds: F.filter("refs", lambda r: classify_reference(r).isin(*kinds))
    pairs = own.select("g", F.explode(side(("agama", "taisho"))).alias("c"), "refs").select("g", "c", F.explode(side(("pali",))).alias("p"))
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "^~+", ""), "#.*$", "")
    chinese = F.coalesce(agama_of(F.col("c")), F.regexp_extract(plain(F.col("c")), r"^(t\d+)", 1))
    agama = F.when(agama_of(F.col("c")).isNotNull(), plain(F.col("c")))
    full = F.max(~F.col("c").startswith("~") & ~F.col("p").startswith("~"))
    return pairs.groupBy(chinese.alias("chinese"), plain(F.col("p")).alias("pali")).agg(full.alias("full"), F.array_sort(F.collect_set(agama)).alias("agamas"), F.count("*").alias("times"))


def sentence_pair_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_pairs): lines that aren't blank, without the heading, of each TSV file."""
    lines = spark.read.text(path, pathGlobFilter="*.tsv").select(F.col("_metadata.file_name").alias("file"), "value")
    return lines.groupBy("file").agg((F.count_if(F.trim("value") != "") - 1).alias("n_pairs"))


def named_pairs(files: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, n_pairs) of (file, n_pairs): every id of one pattern in a file's name with every one of the other."""
    each = files.select("n_pairs", F.explode(ids_of_name(F.col("file"), left)).alias("left"), F.col("file")).select("left", "n_pairs", F.explode(ids_of_name(F.col("file"), right)).alias("right"))
    return each.groupBy("left", "right").agg(F.sum("n_pairs").alias("n_pairs"))


def ids_of_name(name: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)))


def toh_of_file(path: Column) -> Column:
    """Numbers of ``..._toh44-18-title.xml`` (44) or ``toh710,930`` (both) in a path's last part, digits only."""
    raw = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"toh([\d,]+(?:-\d+)?)", 1)
    return F.filter(F.split(F.regexp_replace(raw, r"-\d+$", ""), ","), lambda n: n != "")


def translations(rows: DataFrame) -> DataFrame:
    """(toh, collection, files, english, sanskrit, wylie, tibetan) of translated texts from (path, text) of their TEI.

    Numbers are those of the file's name and of ``bibl`` keys; a main title of a later file, by path, takes the place of
    an earlier one.
    """
    keys = F.regexp_extract_all("text", F.lit(r"<bibl\b[^>]*\bkey=\"toh(\d+)"), F.lit(1))
    title = lambda langs: F.nullif(F.trim(F.regexp_extract("text", rf"<title\b(?=[^>]*\btype=\"mainTitle\")(?=[^>]*\bxml:lang=\"(?:{langs})\")[^>]*>([^<]+)", 1)), F.lit(""))
    langs = {"english": "en", "sanskrit": "[Ss]a-Ltn", "wylie": "[Bb]o-Ltn", "tibetan": "bo"}
    own = rows.select("path", F.regexp_extract("path", r"/(kangyur|tengyur)/", 1).alias("collection"), F.explode(F.array_distinct(F.concat(toh_of_file(F.col("path")), keys))).alias("toh"), *(title(p).alias(c) for c, p in langs.items()))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("path"))).alias(c) for c in langs]
    return own.groupBy("toh").agg(F.min_by("collection", "path").alias("collection"), F.array_sort(F.collect_set("path")).alias("files"), *last)


def sanskrit_titles(rows: DataFrame) -> DataFrame:
    """(toh, title): the first romanised Sanskrit title of a text by each of its ``bibl`` keys, or the number in its file's name."""
    title = F.nullif(F.trim(F.regexp_extract("text", r"<title\b(?=[^>]*\bxml:lang=\"[Ss]a-Ltn\")[^>]*>([^<]+)", 1)), F.lit(""))
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit(r"<bibl\b[^>]*\bkey=\"toh(\d+)"), F.lit(1)))
    numbers = F.when(F.size(keys) > 0, keys).otherwise(toh_of_file(F.col("path")))
    return rows.select(title.alias("title"), F.explode(numbers).alias("toh")).where("title is not null").select(F.col("toh").cast("int").alias("toh"), "title").distinct()


def crossref_table(rows: DataFrame) -> DataFrame:
    """(otani, taisho, has_toh) of (k_number, otani: array, tohoku: array, taisho: array): every number of one with every one of the other."""
    taisho = F.when(F.col("t").startswith("T"), F.col("t")).otherwise(F.concat(F.lit("T"), F.col("t")))
    each = rows.select(F.explode("otani").alias("o"), "taisho", (F.size(F.coalesce("tohoku", F.array().cast("array<string>"))) > 0).alias("has_toh")).select("o", "has_toh", F.explode("taisho").alias("t"))
    return each.select(F.concat(F.lit("Otani "), F.col("o").cast("string")).alias("otani"), taisho.alias("taisho"), "has_toh")


def citation_errors(rows: DataFrame) -> DataFrame:
    """Recorded errors of (citation_key, errors: array of (taisho, tohoku, status, note)) as attestations of ``key:error``."""
    each = rows.select("citation_key", F.explode("errors").alias("e"))
    note = F.concat(F.lit("["), F.coalesce("e.status", F.lit("error")), F.lit("]"), F.when(F.length("e.note") > 0, F.concat(F.lit(" "), F.col("e.note"))).otherwise(F.lit("")))
    return each.select(F.col("e.taisho").alias("text_id"), toh_name(F.col("e.tohoku")).alias("ref_id"), F.concat("citation_key", F.lit(":error")).alias("source"), note.alias("note"))


def toh_name(raw: Column) -> Column:
    return F.when(raw.startswith("Toh "), raw).otherwise(F.concat(F.lit("Toh "), raw))


def embedded_references(rows: DataFrame) -> DataFrame:
    """(toh, taisho): catalogue numbers of the file's name by the Taisho numbers that its body mentions."""
    toh = ids_of_name(F.regexp_extract("path", r"([^/]*)$", 1), r"toh(\d+[a-z]?)")
    body = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"Taish[oō] (?:no\. )?(\d+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"taisho/t0*(\d+)"), F.lit(1))))
    return rows.select(F.explode(toh).alias("toh"), "text").select("toh", F.explode(body).alias("taisho")).distinct()


def citations(rows: DataFrame) -> DataFrame:
    """Attestations from (citation_key, links: array of (taisho, tohoku, source_key, note)); a link may name its source."""
    each = rows.select("citation_key", F.explode("links").alias("l"))
    return each.select(F.col("l.taisho").alias("text_id"), toh_name(F.col("l.tohoku")).alias("ref_id"), F.coalesce("l.source_key", "citation_key").alias("source"), F.col("l.note").alias("note"))
