"""Concordance queries. Attestations of links are derived from line items: order = text, part group = reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concordance as cc
from ..params import ConcordanceParams
from .registry import query, table

P = ConcordanceParams()
SOURCES = ("lancaster", "mitra", "sanskrit_title_match", "rkts_concordance", "mitra", "nattier1992", "sanskrit_title_match", "rkts")
_ARRAY = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"

ATT = f"""
att AS (SELECT l_orderkey % 3000 AS text_id, l_partkey % 15 AS ref_id, ({_ARRAY})[CAST(l_suppkey % 8 AS INT) + 1] AS source,
    CASE WHEN l_suppkey % 8 IN (1, 2, 4, 6) THEN CAST(l_discount * 10 AS DOUBLE) END AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'line ' || l_linenumber ELSE 'n' || l_linenumber END AS note,
    lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS seq FROM lineitem),
merged AS (SELECT text_id, ref_id, source, max(confidence) AS confidence, arg_min(note, seq) FILTER (WHERE note IS NOT NULL) AS note FROM att GROUP BY ALL),
errors AS (SELECT o_orderkey % 3000 AS text_id, o_custkey % 15 AS ref_id, CASE WHEN o_custkey % 9 > 0 THEN ({_ARRAY})[CAST(o_custkey % 8 AS INT) + 1] END AS source, o_custkey % 7 AS correct_ref FROM orders WHERE o_orderpriority = '1-URGENT'),
flagged AS (SELECT m.text_id, m.ref_id, m.source, any_value(confidence) AS confidence, any_value(note) AS note,
    coalesce(min(e.correct_ref) FILTER (WHERE e.source IS NOT NULL), min(e.correct_ref)) AS correct_ref, count(e.text_id) > 0 AS flagged_error
    FROM merged m LEFT JOIN errors e ON m.text_id = e.text_id AND m.ref_id = e.ref_id AND (e.source IS NULL OR e.source = m.source) GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN source IN ('lancaster', 'rkts') THEN 'catalog' WHEN source = 'rkts_concordance' THEN 'infra' WHEN source IN ('mitra', 'sanskrit_title_match') THEN 'computational' ELSE 'scholarly' END AS kind FROM flagged),
links AS (SELECT text_id, ref_id, bool_and(flagged_error) AS flagged, bool_or(source = 'rkts') AS from_chinese, bool_or(kind IN ('catalog', 'scholarly')) AS catalogued,
    max(CASE WHEN kind = 'computational' THEN coalesce(confidence, 0) END) AS best, bool_or(kind = 'computational') AND NOT bool_or(kind IN ('catalog', 'scholarly')) AS only_computed FROM kinds GROUP BY ALL),
counted AS (SELECT *, sum(CASE WHEN only_computed THEN 1 ELSE 0 END) OVER (PARTITION BY text_id) AS n_computed FROM links),
rel AS (SELECT DISTINCT o_orderkey % 3000 AS digest_id, o_custkey % 3000 AS source_id FROM orders WHERE o_orderstatus = 'F'),
inh AS (SELECT DISTINCT digest_id AS text_id, ref_id FROM rel JOIN links ON links.text_id = rel.source_id AND catalogued),
classes AS (SELECT c.text_id, c.ref_id, CASE WHEN flagged THEN 'error:flagged' WHEN from_chinese THEN 'chinese_to_tibetan' WHEN catalogued THEN 'parallel' WHEN inh.ref_id IS NOT NULL THEN 'indirect:inherited'
    WHEN only_computed AND n_computed >= {P.encyclopedic_links} THEN 'indirect:quotation' WHEN only_computed AND best >= {P.computational_confidence} THEN 'parallel:computational' ELSE 'uncertain' END AS link_class
    FROM counted c LEFT JOIN inh USING (text_id, ref_id))
"""


def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n, pad = F.col("l_linenumber"), lambda c, k: F.lpad(F.col(c).cast("string"), k, "0")
    return li.select(
        (F.col("l_orderkey") % 3000).alias("text_id"), (F.col("l_partkey") % 15).alias("ref_id"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("l_suppkey") % 8 + 1).cast("int")).alias("source"),
        F.when((F.col("l_suppkey") % 8).isin(1, 2, 4, 6), F.col("l_discount") * 10).alias("confidence"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, F.concat(F.lit("line "), n.cast("string"))).otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("note"),
        F.concat_ws("-", pad("l_linenumber", 3), pad("l_partkey", 9), pad("l_suppkey", 9), pad("l_orderkey", 12)).alias("seq"),
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    source = F.when(k % 9 > 0, F.element_at(F.array(*map(F.lit, SOURCES)), (k % 8 + 1).cast("int")))
    errors = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") % 3000).alias("text_id"), (k % 15).alias("ref_id"), source.alias("source"), (k % 7).alias("correct_ref"))
    return cc.flag_errors(cc.merge(attestations(spark, sf_dir)), errors)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    rel = o.select((F.col("o_orderkey") % 3000).alias("digest_id"), (F.col("o_custkey") % 3000).alias("source_id")).distinct()
    return cc.classify_links(flagged(spark, sf_dir), rel, P)


@query(f"WITH {ATT} SELECT * FROM merged")
def attestation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.merge(attestations(spark, sf_dir))


@query(f"WITH {ATT} SELECT text_id, ref_id, source, flagged_error, correct_ref FROM flagged")
def flag_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("text_id", "ref_id", "source", "flagged_error", "correct_ref")


@query(f"WITH {ATT} SELECT * FROM classes")
def classify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir)


@query(f"""WITH {ATT}, parents AS (SELECT ref, min(parent) AS parent FROM (SELECT o_custkey % 40 + 100 AS ref, o_orderkey % 15 AS parent FROM orders WHERE o_custkey % 40 < 30) GROUP BY ref),
derived AS (SELECT DISTINCT o_orderkey % 3000 AS text_id, o_custkey % 40 + 100 AS ref_id FROM orders)
SELECT d.text_id, d.ref_id, c.link_class FROM derived d JOIN parents ON ref = d.ref_id JOIN classes c ON c.text_id = d.text_id AND c.ref_id = parent""")
def inherited_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ref = (F.col("o_custkey") % 40 + 100).alias("ref_id")
    derived = o.select((F.col("o_orderkey") % 3000).alias("text_id"), ref).distinct()
    return cc.inherit_class(derived, o.where("o_custkey % 40 < 30").select(ref, (F.col("o_orderkey") % 15).alias("parent_id")), classes(spark, sf_dir))


@query(f"""WITH {ATT} SELECT text_id, ref_id, link_class, sources FROM classes JOIN
(SELECT text_id, ref_id, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM kinds WHERE kind <> 'computational' GROUP BY ALL) USING (text_id, ref_id)
WHERE link_class IN ('parallel', 'chinese_to_tibetan')""")
def verified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.verified(classes(spark, sf_dir), flagged(spark, sf_dir))


@query(f"""WITH {ATT}, p AS (SELECT DISTINCT text_id, ref_id, source FROM att), n AS (SELECT text_id, count(DISTINCT source) AS n_sources FROM p GROUP BY text_id HAVING count(DISTINCT source) >= 2),
r AS (SELECT text_id, ref_id, count(*) AS c FROM p GROUP BY ALL)
SELECT text_id, n_sources, count(*) AS n_refs, CASE WHEN min(c) = n_sources THEN 'full' WHEN max(c) = n_sources THEN 'partial' ELSE 'conflict' END AS agreement FROM r JOIN n USING (text_id) GROUP BY text_id, n_sources""")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.source_agreement(attestations(spark, sf_dir))


@query("SELECT DISTINCT p_brand AS derge, l_suppkey AS otani FROM lineitem JOIN part ON l_partkey = p_partkey")
def kernel_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kernel"), F.col("p_brand").alias("derge"))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("kernel"), F.col("l_suppkey").alias("otani"))
    return cc.bridge(left, right, "kernel")


@query("SELECT c_custkey AS kernel, c_name AS title FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') ON c_custkey = o_custkey")
def left_only_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select(F.col("c_custkey").alias("kernel"), F.col("c_name").alias("title"))


@query("SELECT o_custkey AS ref, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS texts, count(*) AS n FROM orders GROUP BY o_custkey")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ref"))
    return o.agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ";").alias("texts"), F.count("*").alias("n"))


_BANDS = [("agama", 0, 2), ("prajna", 5, 8), ("lotus", 9, 9), ("esoteric", 18, 21)]


@query(f"""WITH bands(name, low, high) AS (VALUES {', '.join(map(str, _BANDS))})
SELECT name, count(*) AS n, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS n_covered, count(*) FILTER (WHERE c_acctbal > 0) * 100.0::DOUBLE / count(*) AS percent FROM customer JOIN bands ON c_nationkey BETWEEN low AND high GROUP BY name""")
def band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("volume"), (F.col("c_acctbal") > 0).alias("covered"))
    return cc.band_coverage(texts, spark.createDataFrame(_BANDS, "name string, low int, high int"))


PAIRS = """
rel AS (SELECT o_orderkey AS k, o_orderkey AS d, o_custkey AS s, ['excerpt', 'digest', 'commentary'][CAST(o_orderkey % 3 AS INT) + 1] AS class FROM orders),
par AS (SELECT l_orderkey AS text, list_sort(list(DISTINCT l_partkey % 40)) AS refs FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
x AS (SELECT k, d, s, class, a.refs AS dr, b.refs AS sr FROM rel LEFT JOIN par a ON a.text = d LEFT JOIN par b ON b.text = s)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    rel = table(spark, sf_dir, "orders").select(
        o.alias("k"), o.alias("d"), F.col("o_custkey").alias("s"), F.element_at(F.array(F.lit("excerpt"), F.lit("digest"), F.lit("commentary")), (o % 3 + 1).cast("int")).alias("class")
    )
    par = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("refs"))
    one = lambda key, refs: par.select(F.col("l_orderkey").alias(key), F.col("refs").alias(refs))
    return rel.join(one("d", "dr"), "d", "left").join(one("s", "sr"), "s", "left")


@query(f"""WITH {PAIRS} SELECT CASE WHEN dr IS NULL AND sr IS NULL THEN 'neither' WHEN dr IS NULL OR sr IS NULL THEN 'one' WHEN list_has_any(dr, sr) THEN 'same' ELSE 'different' END AS status, count(*) AS n FROM x GROUP BY 1""")
def pair_parallel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.col("dr").isNull() & F.col("sr").isNull()
    one = F.col("dr").isNull() | F.col("sr").isNull()
    status = F.when(none, "neither").when(one, "one").when(F.arrays_overlap("dr", "sr"), "same").otherwise("different")
    return pairs(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT class, count(*) AS n, CAST(count(*) FILTER (WHERE coalesce(dr, sr) IS NOT NULL) AS BIGINT) AS n_covered FROM x GROUP BY class")
def coverage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.coalesce("dr", "sr").isNotNull()).alias("n_covered"))


@query(f"""WITH {PAIRS} SELECT class, CAST(count(*) FILTER (WHERE list_has_any(dr, sr)) AS BIGINT) AS shared, count(*) AS both_known,
count(*) FILTER (WHERE list_has_any(dr, sr)) * 100.0::DOUBLE / count(*) AS percent FROM x WHERE dr IS NOT NULL AND sr IS NOT NULL GROUP BY class""")
def shared_id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs(spark, sf_dir).where("dr is not null and sr is not null")
    shared = F.count_if(F.arrays_overlap("dr", "sr"))
    return both.groupBy("class").agg(shared.alias("shared"), F.count("*").alias("both_known"), (shared * 100.0 / F.count("*")).alias("percent"))


@query("""SELECT u.conv_id, u.turn AS user_turn, a.turn AS assistant_turn, contains(u.text, '?') OR contains(a.text, '?') AS partial FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id
WHERE u.role = 'user' AND a.role = 'assistant'""")
def group_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of one kind with every one of the other within a group, as in groups of parallels."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").contains("?").alias("q"))
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"), F.col("q").alias("uq"))
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("assistant_turn"), F.col("q").alias("aq"))
    return u.join(a, "conv_id").select("conv_id", "user_turn", "assistant_turn", (F.col("uq") | F.col("aq")).alias("partial"))


@query("""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY title) AS times FROM t)
SELECT doc_id, length(title) AS n, times FROM c WHERE NOT (length(title) <= 12 OR times > 10)""")
def generic_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose first line is long enough to say something and does not stand over more than ten of them."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    times = t.groupBy("title").agg(F.count("*").alias("times"))
    return t.join(times, "title").where((F.length("title") > 12) & (F.col("times") <= 10)).select("doc_id", F.length("title").cast("long").alias("n"), "times")


@query("""SELECT CAST(count(*) FILTER (WHERE known) AS BIGINT) AS n_held, CAST(count(*) FILTER (WHERE known AND found) AS BIGINT) AS n_found FROM
(SELECT d.doc_id, substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 2) < '33' AS known, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def holdout_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a seeded fifth of the links, how many a method finds again."""
    d = table(spark, sf_dir, "documents").select("doc_id").where(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2) < "33")
    found = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return d.join(found, "doc_id", "left").agg(F.count("*").alias("n_held"), F.count("hit").alias("n_found"))


@query("""SELECT c_custkey AS id, coalesce(max(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), c_mktsegment) AS title, c_nationkey AS nation FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey""")
def metadata_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from several catalogues: the first overwrites, the others fill what is missing."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("title"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), F.col("c_nationkey").alias("nation"))
    first = first.join(known.select("id"), "id", "left_semi")
    rows = first.withColumn("nation", F.lit(None).cast("int")).withColumn("rank", F.lit(1)).unionByName(known.withColumn("rank", F.lit(2)))
    return cc.coalesce_by_priority(rows, "id", ["title", "nation"], "rank")
