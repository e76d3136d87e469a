"""Catalogue queries: files and notes in their published forms, given as small fixed inputs, and merging on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import concordance as cc
from ..params import ConcordanceParams
from ..sources import catalogs, notes
from .registry import query, table

P = ConcordanceParams()


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


KERNEL_XML = [
    (1, "<item><rkts>12</rkts><section>mdo</section><StandardTibetan> rdo rje </StandardTibetan><StandardSanskrit>vajra</StandardSanskrit><cmp><ref>T0310-7</ref><type>translation-taisho</type></cmp><cmp><ref>T0310-9</ref><type>translation-taisho</type></cmp></item>"
        "<item><rkts>13</rkts><cmp><ref>T0670</ref><type>other</type></cmp></item><item><rkts>14a</rkts><English84000>The Heart</English84000><cmp><ref>T0251</ref><type>translation-taisho</type></cmp></item>"),
    (2, "<item>\n<rkts>15</rkts>\n<cmp><ref>T12</ref><type>translation-taisho</type></cmp>\n</item><item><cmp><ref>T1</ref><type>translation-taisho</type></cmp></item>"),
]
DERGE_XML = [(1, "<item><rkts>12</rkts><ref>D45</ref></item><item><rkts>12</rkts>\n<ref>D46</ref><ref>Q7,01</ref></item>"), (2, "<item><rkts>14a</rkts><ref>D21</ref></item><item><rkts>15</rkts><tib>x</tib><ref>D9</ref></item>")]
_TAG = "nullif(trim(regexp_extract(item, '<{0}>([^<]+)', 1)), '')"


@query(rf"""WITH k(seq, text) AS ({_values(KERNEL_XML)}), d(seq, text) AS ({_values(DERGE_XML)}),
pairs AS (SELECT seq, regexp_extract_all(text, '<rkts>([^<]+)</rkts>\s*<ref>D(\d+)</ref>', 1) AS a, regexp_extract_all(text, '<rkts>([^<]+)</rkts>\s*<ref>D(\d+)</ref>', 2) AS b FROM d),
each AS (SELECT seq, i, trim(a[i]) AS rkts, CAST(b[i] AS INT) AS toh FROM pairs, unnest(range(1, len(a) + 1)) t(i)),
derge AS (SELECT rkts, arg_max(toh, seq * 1000 + i) AS toh FROM each GROUP BY rkts),
items AS (SELECT unnest(regexp_extract_all(text, '(?s)<item>(.*?)</item>', 1)) AS item FROM k),
own AS (SELECT {_TAG.format('rkts')} AS rkts, list_distinct(list_transform(regexp_extract_all(item, '<cmp><ref>(T\d+(?:-\d+)?)</ref><type>translation-taisho</type></cmp>', 1), lambda t: 'T' || regexp_extract(t, 'T0*(\d+)', 1))) AS taisho,
    {_TAG.format('section')} AS section, {_TAG.format('StandardTibetan')} AS tibetan, {_TAG.format('StandardSanskrit')} AS sanskrit, {_TAG.format('English84000')} AS english FROM items)
SELECT rkts, toh, array_to_string(list_sort(taisho), ';') AS taisho, section, tibetan, sanskrit, english FROM own LEFT JOIN derge USING (rkts) WHERE len(taisho) > 0 AND rkts IS NOT NULL""")
def kernel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = (spark.createDataFrame(x, "seq int, text string") for x in (KERNEL_XML, DERGE_XML))
    return catalogs.kernel_links(k, catalogs.derge_numbers(d)).withColumn("taisho", F.array_join(F.array_sort("taisho"), ";"))


COLLECTION_XML = [
    ("<item><rkts>12</rkts><ref>D45</ref><ref>Q7,01</ref><tib>rdo rje</tib><skttrans>vajra</skttrans></item><item><rkts>x1</rkts><ref>D1</ref></item><item><rkts>12</rkts><ref>D45</ref><tib>other</tib></item>",),
    ("<item>\n<rkts>13</rkts><ref>N4</ref><ref>Q760a</ref><sanskrit> hrdaya </sanskrit></item><item><rkts>14</rkts><ref>N9</ref></item>",),
]
_WHOLE = "trim(regexp_extract(item, '(?s)<{0}>(.*?)</{0}>', 1))"


@query(rf"""WITH rows(text) AS ({_values(COLLECTION_XML)}), items AS (SELECT unnest(regexp_extract_all(text, '(?s)<item>(.*?)</item>', 1)) AS item FROM rows),
own AS (SELECT regexp_extract(item, '<rkts>(\d+)</rkts>', 1) AS kernel, regexp_extract(item, '<ref>[DQ](\d+(?:[a-z]|,\d+)?)</ref>', 1) AS ref, {_WHOLE.format('tib')} AS tibetan,
    CASE WHEN {_WHOLE.format('skttrans')} <> '' THEN {_WHOLE.format('skttrans')} ELSE {_WHOLE.format('sanskrit')} END AS sanskrit FROM items)
SELECT kernel, ref, min(tibetan) AS tibetan, arg_min(sanskrit, tibetan) AS sanskrit FROM own WHERE kernel <> '' AND ref <> '' GROUP BY kernel, ref""")
def collection_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.collection_items(spark.createDataFrame(COLLECTION_XML, "text string"))


TRANSLATIONS = [
    ("/d/translations/kangyur/035-018_toh44-18-flower.xml", '<TEI><title type="mainTitle" xml:lang="en">Flower</title><title type="mainTitle" xml:lang="Sa-Ltn"> Avataṃsaka </title><title xml:lang="bo" type="mainTitle">བོད</title><bibl key="toh44-18"/></TEI>'),
    ("/d/translations/kangyur/088_toh710,930_name.xml", '<TEI><title type="otherTitle" xml:lang="en">Other</title><title xml:lang="Sa-Ltn" type="longTitle">Aparimita</title><bibl type="x" key="toh710"/><bibl key="toh931"/></TEI>'),
    ("/d/translations/tengyur/z_toh44_second.xml", '<TEI><title type="mainTitle" xml:lang="en">Second</title></TEI>'),
]
_MAIN = "nullif(trim(regexp_extract(text, '<title[^>]*type=\"mainTitle\"[^>]*xml:lang=\"{0}\"[^>]*>([^<]+)|<title[^>]*xml:lang=\"{0}\"[^>]*type=\"mainTitle\"[^>]*>([^<]+)', {1})), '')"
_TOH_FILE = r"list_filter(string_split(regexp_replace(regexp_extract(regexp_extract(path, '([^/]*)$', 1), 'toh([\d,]+(?:-\d+)?)', 1), '-\d+$', ''), ','), lambda n: n <> '')"


@query(rf"""WITH rows(path, text) AS ({_values(TRANSLATIONS)}),
own AS (SELECT path, unnest(list_distinct(list_concat({_TOH_FILE}, regexp_extract_all(text, '<bibl[^>]* key="toh(\d+)', 1)))) AS toh,
    coalesce({_MAIN.format('en', 1)}, {_MAIN.format('en', 2)}) AS english, coalesce({_MAIN.format('Sa-Ltn', 1)}, {_MAIN.format('Sa-Ltn', 2)}) AS sanskrit, coalesce({_MAIN.format('bo', 1)}, {_MAIN.format('bo', 2)}) AS tibetan FROM rows)
SELECT toh, count(DISTINCT path) AS n_files, arg_max(english, path) FILTER (WHERE english IS NOT NULL) AS english, arg_max(sanskrit, path) FILTER (WHERE sanskrit IS NOT NULL) AS sanskrit, arg_max(tibetan, path) FILTER (WHERE tibetan IS NOT NULL) AS tibetan FROM own GROUP BY toh""")
def translation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogs.translations(spark.createDataFrame(TRANSLATIONS, "path string, text string"))
    return out.select("toh", F.size("files").cast("long").alias("n_files"), "english", "sanskrit", "tibetan")


@query(rf"""WITH rows(path, text) AS ({_values(TRANSLATIONS)}),
own AS (SELECT trim(regexp_extract(text, '<title[^>]*xml:lang="[Ss]a-Ltn"[^>]*>([^<]+)', 1)) AS title, regexp_extract_all(text, '<bibl[^>]* key="toh(\d+)', 1) AS keys, {_TOH_FILE} AS named FROM rows)
SELECT DISTINCT CAST(unnest(CASE WHEN len(keys) > 0 THEN keys ELSE named END) AS INT) AS toh, title FROM own WHERE title <> ''""")
def translation_sanskrit_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.sanskrit_titles(spark.createDataFrame(TRANSLATIONS, "path string, text string"))


GROUPS = [["ma26", "mn69#2.1", "~mn70", "t1509"], ["ma26", "mn69"], ["sa-2.180", "sn1.1", "pli-tv-bu-vb-pj1", "da"], ["t9.5", "~mil3.1", "dn"], ["ea44.5", "uv3", "dnx"], ["sa.5", "tha-ap3"]]
_PALI = "|".join(sorted((p for p in catalogs.PALI if p != "pli-tv"), key=len, reverse=True))
_AGAMA = "|".join(catalogs.AGAMAS)


@query(rf"""WITH groups(g, refs) AS (VALUES {', '.join(f'({i}, {_literal(r)})' for i, r in enumerate(GROUPS))}),
each AS (SELECT g, unnest(refs) AS ref FROM groups), plain AS (SELECT g, ref, regexp_replace(regexp_replace(ref, '^~+', ''), '#.*$', '') AS name, starts_with(ref, '~') AS partial FROM each),
kinds AS (SELECT *, CASE WHEN regexp_matches(name, '^({_AGAMA})\.?\d') THEN 'agama' WHEN regexp_matches(name, '^t\d') THEN 'taisho'
    WHEN regexp_matches(name, '^(?:{_PALI})(?:$|[\d.\-])|^pli-tv') THEN 'pali' ELSE 'other' END AS kind FROM plain)
SELECT CASE WHEN c.kind = 'agama' THEN regexp_extract(c.name, '^({_AGAMA})\.?\d', 1) ELSE regexp_extract(c.name, '^(t\d+)', 1) END AS chinese, p.name AS pali, bool_or(NOT c.partial AND NOT p.partial) AS "full",
coalesce(string_agg(DISTINCT CASE WHEN c.kind = 'agama' THEN c.name END, ';' ORDER BY CASE WHEN c.kind = 'agama' THEN c.name END), '') AS agamas, count(*) AS times
FROM kinds c JOIN kinds p ON c.g = p.g WHERE c.kind IN ('agama', 'taisho') AND p.kind = 'pali' GROUP BY 1, 2""")
def parallel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogs.parallel_groups(spark.createDataFrame([(r,) for r in GROUPS], "refs array<string>"))
    return out.withColumn("agamas", F.array_join("agamas", ";"))


FILES = [("T08n0251-T08n0252_D21-D531.tsv", 40), ("T01n0001_D7.tsv", 3), ("T08n0251_D21.tsv", 5), ("readme.tsv", 9)]


@query(rf"""WITH files(file, n) AS ({_values(FILES)}), a AS (SELECT n, file, unnest(list_distinct(regexp_extract_all(file, 'T\d{{2}}n\d{{4}}'))) AS "left" FROM files),
b AS (SELECT n, "left", unnest(list_distinct(regexp_extract_all(file, 'D(\d+)', 1))) AS "right" FROM a) SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n_pairs FROM b GROUP BY ALL""")
def file_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.named_pairs(spark.createDataFrame(FILES, "file string, n_pairs long"), r"(T\d{2}n\d{4})", r"D(\d+)")


CROSSREF_ROWS = [("K1", ["731", "732"], ["12"], ["220", "T221"]), ("K2", ["5"], None, ["7"]), ("K3", [], ["1"], ["8"])]


@query(f"""WITH rows(k, otani, tohoku, taisho) AS ({_values(CROSSREF_ROWS)}), a AS (SELECT unnest(otani) AS o, taisho, len(coalesce(tohoku, [])) > 0 AS has_toh FROM rows), b AS (SELECT o, unnest(taisho) AS t, has_toh FROM a)
SELECT 'Otani ' || o AS otani, CASE WHEN starts_with(t, 'T') THEN t ELSE 'T' || t END AS taisho, has_toh FROM b""")
def crossref_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.crossref_table(spark.createDataFrame(CROSSREF_ROWS, "k_number string, otani array<string>, tohoku array<string>, taisho array<string>"))


NOTES = [("Nj. 399. K. 5. Cf. 251-253, 257 後秦 31",), ("Cf. 26 (99-101), 125 (48, 4) 唐",), ("K. 650, K. 7. 東晉 2",), ("Nj. 1, Nj. 22",), ("", ), ("Cf. 7 12",)]
_DYN = notes.DYNASTIES


@query(rf"""WITH n(note) AS ({_values(NOTES)}), c AS (SELECT note, string_split(regexp_replace(regexp_extract(note, 'Cf\.\s*(.+?)(?:\s*{notes.CF_END}|\s*\d{{1,2}}\s*$)', 1), '\([^)]*\)', '', 'g'), ',') AS parts FROM n),
e AS (SELECT note, parts, list_filter(list_transform(parts, lambda x: CASE WHEN regexp_matches(trim(x), '^\d+\s*-\s*\d+') THEN
    array_to_string(list_transform(range(CAST(regexp_extract(trim(x), '^(\d+)', 1) AS BIGINT), CAST(regexp_extract(trim(x), '-\s*(\d+)', 1) AS BIGINT) + 1), lambda v: CAST(v AS VARCHAR)), ';') WHEN regexp_matches(trim(x), '^\d+$') THEN trim(x) ELSE '' END), lambda x: x <> '') AS cf FROM c)
SELECT note, array_to_string(regexp_extract_all(note, 'Nj\.\s*(\d+)', 1), ';') AS nanjio, array_to_string(regexp_extract_all(note, 'K\.\s*(\d+)', 1), ';') AS korean, array_to_string(cf, ';') AS compared,
nullif(regexp_extract(note, '({_DYN})\s*\d*\s*$', 1), '') AS dynasty, TRY_CAST(nullif(regexp_extract(note, '(?:{_DYN})\s*(\d+)\s*$', 1), '') AS INT) AS page FROM e""")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, joined = F.col("note"), lambda c: F.array_join(c.cast("array<string>"), ";")
    df = spark.createDataFrame(NOTES, "note string")
    return df.select("note", joined(notes.nanjio_numbers(n)).alias("nanjio"), joined(notes.korean_numbers(n)).alias("korean"), joined(notes.compared_numbers(n)).alias("compared"), notes.dynasty(n).alias("dynasty"), notes.page_number(n).alias("page"))


@query("""WITH w AS (SELECT o_custkey AS p, list_sort(list(DISTINCT CAST(o_orderkey % 50 AS VARCHAR))) AS works FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
a AS (SELECT o_custkey AS p, list(DISTINCT CAST(o_orderkey % 50 AS VARCHAR)) AS attributions FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
r AS (SELECT o_custkey AS p, list(DISTINCT o_orderpriority) AS refs FROM orders WHERE o_totalprice > 150000 GROUP BY 1)
SELECT p AS person_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(works, []), coalesce(attributions, [])))), ';') AS texts, array_to_string(list_sort(refs), ';') AS refs FROM r LEFT JOIN w USING (p) LEFT JOIN a USING (p) WHERE works IS NOT NULL OR attributions IS NOT NULL""")
def indirect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with texts of two kinds and references; here customers with their orders."""
    o = table(spark, sf_dir, "orders")
    some = lambda where, value, name: o.where(where).groupBy(F.col("o_custkey").alias("person_id")).agg(F.collect_set(value).alias(name))
    text = (F.col("o_orderkey") % 50).cast("string")
    persons = some("o_totalprice > 150000", F.col("o_orderpriority"), "refs").join(some("o_orderstatus = 'F'", text, "works"), "person_id", "left").join(some("o_orderstatus = 'P'", text, "attributions"), "person_id", "left")
    return notes.indirect_links(persons).select("person_id", F.array_join("texts", ";").alias("texts"), F.array_join("refs", ";").alias("refs"))


_CELL = "<div>{}</div><div>{}</div>"
PAGES = [
    ("T0001", "<span>規範碼：</span>CA001</div><div><span>經名：</span>長阿含經</div>" + _CELL.format("東北大學藏經目錄", "To. 45-47, 289. (313, 46)") + _CELL.format("西藏大藏經甘殊爾勘同目錄", "O. 750, 760(5).") + "高麗藏經目錄"),
    ("T0002", _CELL.format("其他目錄", "Nj. 5; To. 34, 557; O. 7")), ("T0003", _CELL.format("東北大學藏經目錄", "To. 1-900") + _CELL.format("西藏大藏經甘殊爾勘同目錄", "See below")),
    ("T0004", "<div>nothing</div>"), ("T0005", _CELL.format("東北大學藏經目錄", "n3 556 (21)")),
]
_EXPECTED_PAGES = [("T0001", n, "primary") for n in (45, 46, 47, 289)] + [("T0001", 313, "secondary")] + [("T0002", 34, "primary"), ("T0002", 557, "primary"), ("T0003", 1, "primary"), ("T0003", 900, "primary"), ("T0005", 556, "primary"), ("T0005", 21, "secondary")]


@query(f"SELECT * FROM ({_values(_EXPECTED_PAGES)}) t(text_id, toh, status)")
def catalogue_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of stored catalogue pages, primary before secondary; the SQL lists what the fields of the five pages say."""
    return notes.primary_first(notes.catalogue_page(spark.createDataFrame(PAGES, "text_id string, html string"))).withColumn("toh", F.col("toh").cast("int"))


@query("""WITH m AS (SELECT l_suppkey AS taisho, CAST(l_partkey AS VARCHAR) AS title, l_returnflag || l_linestatus AS method, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS rank FROM lineitem),
o AS (SELECT taisho, title, min((rank, method)) AS best FROM m GROUP BY taisho, title)
SELECT taisho, string_agg(title, ';' ORDER BY title) AS titles, string_agg(DISTINCT best[2], ';' ORDER BY best[2]) AS methods FROM (SELECT taisho, title, [CAST(best[1] AS VARCHAR), best[2]] AS best FROM o) GROUP BY taisho""")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several matches of one title the first method counts; here suppliers with their parts by flag and status."""
    mode, flag = F.concat("l_returnflag", "l_linestatus"), F.col("l_returnflag")
    rank = F.when(flag == "R", 1).when(flag == "A", 2).otherwise(3)
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("taisho"), F.col("l_partkey").cast("string").alias("tibetan_title"), mode.alias("method"), rank.alias("rank"))
    return notes.dictionary_matches(m).select("taisho", F.array_join("titles", ";").alias("titles"), F.array_join("methods", ";").alias("methods"))


@query("""SELECT DISTINCT 'Nj ' || c_nationkey AS nanjio, CAST(c_custkey AS VARCHAR) AS taisho FROM customer UNION SELECT 'Nj ' || s_nationkey, CAST(s_suppkey AS VARCHAR) FROM supplier""")
def nanjio_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues' numbers for texts; one names them bare, the other with a prefix and in lists."""
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("nanjio"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("taisho"))
    right = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("Nj "), F.col("s_nationkey").cast("string")).alias("nanjio")).agg(F.collect_list(F.col("s_suppkey").cast("string")).alias("taisho"))
    return notes.nanjio_map(left, right)


@query("""SELECT p_partkey, 'T' || lpad(CAST(p_partkey % 56 AS VARCHAR), 2, '0') || 'n' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 4 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END || 'A' AS in_volume,
'T' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 4 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END || 'a' AS catalogue, '59.xml+id(b' || p_partkey || ')' AS entry FROM part""")
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    raw, volume = F.concat(F.lit("T"), key, F.lit("A")), F.concat(F.lit("T"), F.lpad((F.col("p_partkey") % 56).cast("string"), 2, "0"))
    link = F.concat(F.lit("http://x/xpr-ddb.pl?59.xml+id('b"), key, F.lit("')"))
    return table(spark, sf_dir, "part").select("p_partkey", ids.id_in_volume(raw, volume).alias("in_volume"), ids.catalogue_id(raw).alias("catalogue"), ids.dictionary_id(link).alias("entry"))


@query("""WITH corpus AS (SELECT 'T' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || 'n' || lpad(CAST(s_suppkey % 3000 AS VARCHAR), 4, '0') AS id, s_suppkey % 3000 AS n FROM supplier), small AS (SELECT n, min(id) AS id FROM corpus GROUP BY n),
raw AS (SELECT o_orderkey AS k, o_orderkey % 3 AS form, o_custkey % 3000 AS n, 'T' || lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') || 'n' || lpad(CAST(o_custkey % 3000 AS VARCHAR), 4, '0') AS whole FROM orders)
SELECT k, CASE WHEN form = 0 THEN small.id WHEN form = 1 THEN whole WHEN whole IN (SELECT id FROM corpus) THEN whole ELSE whole || 'b' END AS text_id FROM raw LEFT JOIN small ON form = 0 AND small.n = raw.n""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare numbers, canonical ids, and ids with a letter that the corpus may lack."""
    four = lambda c: F.lpad((c % 3000).cast("string"), 4, "0")
    corpus = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("n"), four(F.col("s_suppkey"))).alias("text_id"))
    o, n = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.concat(F.lit("T"), F.lpad((o % 25).cast("string"), 2, "0"), F.lit("n"), four(n))
    raw = F.when(o % 3 == 0, F.concat(F.lit("T"), (n % 3000).cast("string"))).when(o % 3 == 1, whole).otherwise(F.concat(whole, F.lit("b")))
    return ids.resolved(table(spark, sf_dir, "orders").select(o.alias("k"), raw.alias("raw")), corpus).select("k", "text_id")


# The sources of links in the order in which they are merged.
SOURCES = ("existing", "lancaster", "lancaster_full", "acmuller_tohoku", "cbeta_tibetan", "cbeta_sanskrit", "84000_tei_refs", "rkts", "sanskrit_title_match", "silk2019", "mitra", "suttacentral_parallels")
LINES = tuple(range(1, 8))
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_KEYS = [*LINES, *PRIORITIES]
MERGED = f"""
raw AS (SELECT l_orderkey % 5000 AS text_id, l_partkey % 2000 AS ref_id, l_linenumber - 1 AS seq, CAST(l_quantity AS DOUBLE) / 50 AS confidence, l_returnflag <> 'R' AS ok FROM lineitem
    UNION ALL SELECT o_orderkey % 5000, o_custkey % 2000, 6 + list_position({_literal(list(PRIORITIES))}, o_orderpriority), CAST(o_orderkey % 11 AS DOUBLE) / 10, o_orderstatus <> 'F' FROM orders),
att AS (SELECT text_id, ref_id, {_literal(list(SOURCES))}[seq + 1] AS source, seq, confidence, CASE seq WHEN 8 THEN ok WHEN 10 THEN confidence >= 0.9 ELSE true END AS active FROM raw),
otani AS (SELECT DISTINCT p_partkey % 2000 AS ref_id, 100000 + p_size AS otani FROM part),
more AS (SELECT DISTINCT text_id, otani AS ref_id, 'rkts_concordance' AS source, true AS active FROM att JOIN otani USING (ref_id) WHERE active),
every AS (SELECT text_id, ref_id, source, active FROM att UNION ALL SELECT * FROM more),
links AS (SELECT text_id, ref_id, count(DISTINCT source) AS n_sources FROM every GROUP BY ALL HAVING bool_or(active))
"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve sources' links; here lines by their number and orders by priority."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines = li.select((F.col("l_orderkey") % 5000).alias("text_id"), (F.col("l_partkey") % 2000).alias("ref_id"), F.col("l_linenumber").alias("by"), (F.col("l_quantity").cast("double") / 50).alias("confidence"), (F.col("l_returnflag") != "R").alias("ok"))
    orders = o.select((F.col("o_orderkey") % 5000).alias("text_id"), (F.col("o_custkey") % 2000).alias("ref_id"), F.col("o_orderpriority").alias("by"), ((F.col("o_orderkey") % 11).cast("double") / 10).alias("confidence"), (F.col("o_orderstatus") != "F").alias("ok"))
    frames = {}
    for name, key in zip(SOURCES, _KEYS):
        own = (lines if key in LINES else orders).where(F.col("by") == key).drop("by")
        frames[name] = own.withColumnRenamed("ok", "active") if name == "sanskrit_title_match" else own.drop("ok")
    otani = table(spark, sf_dir, "part").select((F.col("p_partkey") % 2000).alias("ref_id"), (100000 + F.col("p_size")).alias("otani")).distinct()
    return cc.enriched(cc.attestations_of(frames, P.strong_confidence), otani)


@query(f"WITH {MERGED} SELECT text_id, ref_id, n_sources FROM links")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.active_links(merged(spark, sf_dir))


@query(f"WITH {MERGED} SELECT source, count(DISTINCT text_id) AS n_texts, count(DISTINCT (text_id, ref_id)) AS n_links FROM every GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.source_counts(merged(spark, sf_dir))


@query(f"""WITH {MERGED} SELECT CASE WHEN ref_id BETWEEN 1 AND 1108 THEN 'scripture' ELSE 'commentary' END AS part, count(DISTINCT text_id) AS n_texts, count(DISTINCT ref_id) AS n_refs FROM links WHERE ref_id BETWEEN 1 AND 99999 GROUP BY 1""")
def verified_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.range_counts(cc.active_links(merged(spark, sf_dir)).where("ref_id < 100000"), "ref_id")


BEFORE = "before AS (SELECT DISTINCT o_orderkey % 6000 AS text_id, o_custkey % 2000 AS ref_id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"""WITH {MERGED}, {BEFORE}, b AS (SELECT text_id, b.ref_id IS NOT NULL AS old, l.ref_id IS NOT NULL AS now FROM (SELECT text_id, ref_id FROM links) l FULL JOIN before b USING (text_id, ref_id)),
c AS (SELECT text_id, CAST(count(*) FILTER (WHERE old) AS BIGINT) AS n_before, CAST(count(*) FILTER (WHERE now) AS BIGINT) AS n_now, CAST(count(*) FILTER (WHERE NOT old) AS BIGINT) AS added FROM b GROUP BY text_id)
SELECT *, CASE WHEN n_before = 0 THEN 'new' WHEN n_now = 0 THEN 'gone' WHEN added > 0 THEN 'grown' ELSE 'same' END AS status FROM c""")
def concordance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") % 6000).alias("text_id"), (F.col("o_custkey") % 2000).alias("ref_id"))
    return cc.compared(cc.active_links(merged(spark, sf_dir)), before)


@query(f"""WITH {MERGED}, bad AS (SELECT DISTINCT o_orderkey % 5000 AS text_id, o_custkey % 2000 AS ref_id FROM orders WHERE o_orderpriority = '2-HIGH'),
good AS (SELECT text_id, ref_id, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM every ANTI JOIN bad USING (text_id, ref_id) GROUP BY ALL)
SELECT text_id, ref_id, coalesce(sources, 'unknown') AS sources FROM links LEFT JOIN good USING (text_id, ref_id)""")
def exported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each link without flagged ones; here links that some urgent-but-one order repeats are flagged."""
    every = merged(spark, sf_dir)
    errors = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select((F.col("o_orderkey") % 5000).alias("text_id"), (F.col("o_custkey") % 2000).alias("ref_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("correct_ref"))
    return cc.exported_sources(cc.flag_errors(every, errors), cc.active_links(every)).withColumn("sources", F.array_join("sources", "; "))


@query(f"""WITH {MERGED}, l AS (SELECT text_id, ref_id, bool_or(source = 'mitra') AS a, bool_or(source = 'sanskrit_title_match') AS b, bool_or(source NOT IN ('mitra', 'sanskrit_title_match')) AS other FROM every GROUP BY ALL)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS kind, other, count(*) AS n_links FROM l WHERE a OR b GROUP BY ALL""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.overlap(merged(spark, sf_dir), "mitra", "sanskrit_title_match")


@query(f"""WITH {MERGED}, mapped AS (SELECT DISTINCT 100000 + p_size AS ref_id FROM part WHERE p_brand < 'Brand#30'), known AS (SELECT text_id, ref_id FROM links WHERE ref_id > 100000)
SELECT ref_id, string_agg(CAST(text_id AS VARCHAR), ';' ORDER BY text_id) AS texts FROM (SELECT DISTINCT * FROM known ANTI JOIN (SELECT ref_id FROM mapped WHERE ref_id % 2 = 0) USING (ref_id)) GROUP BY ref_id""")
def orphan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the other edition that the concordance has and the edition map lacks; here the map has the even sizes of some brands."""
    mapped = table(spark, sf_dir, "part").where("p_brand < 'Brand#30' and p_size % 2 = 0").select((100000 + F.col("p_size")).alias("ref_id")).distinct()
    return cc.orphans(cc.active_links(merged(spark, sf_dir)).where("ref_id > 100000"), mapped).withColumn("texts", F.array_join(F.col("texts").cast("array<string>"), ";"))


RELATIONS = "rel AS (SELECT o_orderkey AS digest_id, o_custkey AS source_id FROM orders), xref AS (SELECT DISTINCT l_orderkey AS text_id FROM lineitem WHERE l_returnflag = 'R')"


def relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rel = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("digest_id"), F.col("o_custkey").alias("source_id"))
    return rel, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("text_id")).distinct()


@query(f"WITH {RELATIONS} SELECT digest_id AS text_id FROM rel UNION SELECT source_id FROM rel UNION SELECT text_id FROM xref")
def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.corpus_ids(*relations(spark, sf_dir))


@query(f"""WITH {RELATIONS}, each AS (SELECT digest_id AS text_id, 'digest' AS role FROM rel UNION SELECT source_id, 'source' FROM rel UNION SELECT digest_id, 'any' FROM rel UNION SELECT source_id, 'any' FROM rel)
SELECT role, count(*) AS n_texts, count(x.text_id) AS n_covered FROM each LEFT JOIN xref x USING (text_id) GROUP BY role""")
def unique_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.text_coverage(*relations(spark, sf_dir))


@query("""WITH par AS (SELECT 'T' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END AS text_id, p_brand AS refs FROM part), rel AS (SELECT l_orderkey AS k, l_linenumber AS n, 'T' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ['', 'a', '-7'][CAST(l_linenumber % 3 AS INT) + 1] AS d FROM lineitem)
SELECT k, n, coalesce(o.refs, s.refs) AS refs FROM rel LEFT JOIN par o ON o.text_id = d LEFT JOIN par s ON s.text_id = regexp_replace(regexp_replace(d, '[-_].*$', ''), '[A-Za-z]+$', '')""")
def parallels_with_base_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a text, or else of its id without the suffix."""
    name = lambda c, tail: F.concat(F.lit("T"), F.lpad(c.cast("string"), 6, "0"), tail)
    par = table(spark, sf_dir, "part").select(name(F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("")).alias("text_id"), F.col("p_brand").alias("refs"))
    tail = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("-7")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rel = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), name(F.col("l_partkey"), tail).alias("d"))
    return cc.with_base_id(rel, par, "d").select("k", "n", "refs")


VERDICTS = "j AS (SELECT o_orderkey AS entry_id, o_custkey AS text_id, CASE WHEN o_orderstatus = 'F' THEN 'MATCH' WHEN o_orderstatus = 'O' AND o_orderpriority < '4' THEN 'NO_MATCH' ELSE 'UNCERTAIN' END AS verdict, CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority >= '4') THEN 50 ELSE CAST(o_orderkey % 101 AS INT) END AS certainty FROM orders)"


@query(f"""WITH {VERDICTS}, known AS (SELECT c_custkey AS text_id FROM customer WHERE c_acctbal > 0), x AS (SELECT j.*, k.text_id IS NOT NULL AS known FROM j LEFT JOIN known k USING (text_id))
SELECT count(*) AS candidates, {', '.join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {n}" for n, c in (('matches', "verdict = 'MATCH'"), ('no_match', "verdict = 'NO_MATCH'"), ('uncertain', "verdict = 'UNCERTAIN'"), ('high', "verdict = 'MATCH' AND certainty >= 90"), ('medium', "verdict = 'MATCH' AND certainty BETWEEN 60 AND 89"), ('low', "verdict = 'MATCH' AND certainty < 60"), ('validated', "verdict = 'MATCH' AND known"), ('new', "verdict = 'MATCH' AND NOT known")))},
count(DISTINCT text_id) FILTER (WHERE verdict = 'MATCH' AND NOT known) AS new_texts, count(DISTINCT entry_id) FILTER (WHERE verdict = 'MATCH' AND NOT known) AS new_entries FROM x""")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of an outside judgement of pairs; pairs that it leaves out stay uncertain."""
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("text_id"))
    given = o.where("o_orderstatus = 'F' or (o_orderstatus = 'O' and o_orderpriority < '4')").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("text_id"), F.when(F.col("o_orderstatus") == "F", "MATCH").otherwise("NO_MATCH").alias("verdict"), (F.col("o_orderkey") % 101).cast("int").alias("certainty")
    )
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("text_id"))
    return cc.verdict_summary(cc.verdicts_or_uncertain(pairs, given), known)
