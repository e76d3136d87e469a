"""Title and identifier queries on parts, customers, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles as tt
from ..operators import concordance, phonetic, title_match
from ..params import TitleParams
from .registry import query, table

P = TitleParams()
#: Parts of a nation's customers, each of which meets all its suppliers in a task of its own.
SALTS = 16

SEPARATORS = r"""[-–—.\s()\[\]{},;:/'"*?!]+"""
_SQL_SEPARATORS = SEPARATORS.replace("'", "''")
TITLE = "p_name || ' ' || p_type || ' ' || p_brand"
SIDES = f"""
t AS (SELECT p_partkey AS id, {TITLE} AS title, regexp_replace(lower({TITLE}), '{_SQL_SEPARATORS}', '', 'g') AS norm FROM part),
lt AS (SELECT * FROM t WHERE id % 2 = 0), rt AS (SELECT * FROM t WHERE id % 2 = 1),
ln AS (SELECT norm AS l, list_distinct(list_filter(regexp_split_to_array(lower(min(title)), '{_SQL_SEPARATORS}'), lambda x: length(x) >= 2)) AS lk FROM lt GROUP BY norm),
rn AS (SELECT norm AS r, list_distinct(list_filter(regexp_split_to_array(lower(min(title)), '{_SQL_SEPARATORS}'), lambda x: length(x) >= 2)) AS rk FROM rt GROUP BY norm),
ex AS (SELECT l, r, 1.0::DOUBLE AS score FROM ln JOIN rn ON l = r),
ja AS (SELECT l, r, len(list_intersect(lk, rk)) / (len(lk) + len(rk) - len(list_intersect(lk, rk))) AS score FROM ln JOIN rn ON l <> r AND list_has_any(lk, rk)),
tok AS (SELECT * FROM ja WHERE score >= {P.token_jaccard}),
lev AS (SELECT l, r, levenshtein(l, r) AS d, greatest(length(l), length(r)) AS m FROM ln JOIN rn ON l <> r AND abs(length(l) - length(r)) <= 0.12 * greatest(length(l), length(r)) AND least(length(l), length(r)) >= {P.fuzzy_least_length}),
fuz AS (SELECT l, r, 1 - d / m AS score FROM lev WHERE d <= CAST(floor(m * (1 - {P.fuzzy_ratio}::DOUBLE)) AS INT) AND 1 - d / m >= {P.fuzzy_ratio})
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    t = title_match.normalised(t)
    return t.where("id % 2 = 0"), t.where("id % 2 = 1")


@query(f"WITH {SIDES} SELECT lt.id AS left_id, rt.id AS right_id FROM lt JOIN rt USING (norm)")
def title_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return left.select(F.col("id").alias("left_id"), "norm").join(right.select(F.col("id").alias("right_id"), "norm"), "norm").drop("norm")


@query(f"WITH {SIDES} SELECT l, r, round(score, 9) AS score FROM tok")
def title_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_match.shared_tokens(*sides(spark, sf_dir), P.token_jaccard).select("l", "r", F.round("score", 9).alias("score"))


@query(f"WITH {SIDES} SELECT l, r, round(score, 9) AS score FROM fuz")
def title_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_match.few_edits(*sides(spark, sf_dir), P.fuzzy_ratio, P.fuzzy_least_length).select("l", "r", F.round("score", 9).alias("score"))


@query(f"""WITH {SIDES}, a AS (SELECT l, r, score, 'exact' AS kind FROM ex UNION ALL SELECT l, r, score, 'token' FROM tok
    UNION ALL SELECT l, r, score, 'fuzzy' FROM fuz ANTI JOIN tok USING (l, r)),
e AS (SELECT lt.id AS left_id, rt.id AS right_id, kind, max(score) AS score FROM a JOIN lt ON lt.norm = l JOIN rt ON rt.norm = r GROUP BY ALL)
SELECT left_id, right_id, kind, round(score, 9) AS score FROM e WHERE kind = 'exact' OR (left_id, right_id) NOT IN (SELECT (left_id, right_id) FROM e WHERE kind = 'exact')""")
def title_match_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_match.match(*sides(spark, sf_dir), P).select("left_id", "right_id", "kind", F.round("score", 9).alias("score"))


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey AS text, o_custkey % 55 + 1 AS vol, o_orderkey % 2000 - 50 AS toh, CASE WHEN o_orderstatus = 'F' THEN 'exact' ELSE 'fuzzy' END AS kind FROM orders),
known AS (SELECT o_custkey AS text, list(DISTINCT o_orderkey % 2000 - 50) AS tohs FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT k, CASE WHEN toh > 0 AND kind <> 'exact' AND ((vol BETWEEN 1 AND 21 AND toh >= 1109) OR (vol BETWEEN 25 AND 32 AND toh <= 1108)) THEN 'filtered'
WHEN tohs IS NULL THEN 'new' WHEN list_contains(tohs, toh) THEN 'validated' ELSE 'contradicted' END AS status FROM m LEFT JOIN known USING (text) WHERE toh >= 0""")
def match_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumnsRenamed({"text": "text_id", "vol": "volume"})
    known = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("text_id"), (F.col("o_orderkey") % 2000 - 50).alias("toh"))
    return title_match.validated(m, known).select("k", "status")


MATCHES = "m AS (SELECT o_orderkey AS k, o_custkey AS text, o_custkey % 55 + 1 AS vol, o_orderkey % 2000 - 50 AS toh, CASE WHEN o_orderstatus = 'F' THEN 'exact' ELSE 'fuzzy' END AS kind FROM orders)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("text"), (F.col("o_custkey") % 55 + 1).alias("vol"), (F.col("o_orderkey") % 2000 - 50).alias("toh"), F.when(F.col("o_orderstatus") == "F", "exact").otherwise("fuzzy").alias("kind")
    )


@query(f"WITH {MATCHES} SELECT k, vol, toh, kind FROM m WHERE toh > 0 AND NOT (kind <> 'exact' AND ((vol BETWEEN 1 AND 21 AND toh >= 1109) OR (vol BETWEEN 25 AND 32 AND toh <= 1108)))")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).where("toh > 0")
    return m.where(~title_match.section_mismatch(F.col("vol"), F.col("toh"), F.col("kind"))).drop("text")


@query(f"WITH {MATCHES} SELECT k, vol BETWEEN 1 AND 21 AND toh >= 1109 AND bool_or(toh BETWEEN 1 AND 1108) OVER (PARTITION BY text) AS demoted FROM m WHERE toh > 0")
def section_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where("toh > 0").select("k", title_match.demoted(F.col("vol"), F.col("toh"), "text").alias("demoted"))


@query("""WITH p AS (SELECT c_custkey, s_suppkey, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS a, regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g') AS b, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS x, CASE WHEN starts_with(s_name, 'Supplier#') THEN substr(s_name, 10) ELSE s_name END AS y
FROM customer JOIN supplier ON c_nationkey = s_nationkey),
q AS (SELECT *, list_distinct(string_split(x, '')) AS xs, list_distinct(string_split(y, '')) AS ys FROM p),
s AS (SELECT *, len(list_intersect(xs, ys)) / (len(xs) + len(ys) - len(list_intersect(xs, ys))) AS share, least(length(x), length(y)) AS short FROM q)
SELECT c_custkey, s_suppkey, round(CASE WHEN a = b THEN 1.0 WHEN x = y THEN 0.95 WHEN short >= 2 AND (contains(x, y) OR contains(y, x)) THEN 0.9
WHEN short <= 3 AND share >= 0.7 THEN share WHEN short > 3 AND share >= 0.4 THEN share ELSE 0.0 END, 9)::DOUBLE AS score FROM s""")
def cjk_title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all pairs within a nation. Titles are prepared before they are paired; a nation's pairs are dealt over ``SALTS``."""
    side = lambda t, key, x: table(spark, sf_dir, t).select(key, F.col(f"{x}_nationkey").alias("nation"), tt.title_parts(F.col(f"{x}_name"), ("Customer#", "Supplier#"), "A-Za-z0-9").alias(f"p_{x}"))
    c = side("customer", "c_custkey", "c").withColumn("salt", F.pmod(F.xxhash64("c_custkey"), F.lit(SALTS)).cast("int"))
    s = side("supplier", "s_suppkey", "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a set number of parts, since small tables would be put into few of them whatever their pairs are
    n = max(64, 4 * spark.sparkContext.defaultParallelism)
    flat = lambda df, x: df.select("*", *(F.col(f"p_{x}.{f}").alias(f"{x}_{f}") for f in ("own", "bare", "part", "set"))).drop(f"p_{x}").repartition(n, "nation", "salt")
    pairs = flat(c, "c").join(flat(s, "s"), ["nation", "salt"])
    u, v = ({f: F.col(f"{x}_{f}") for f in ("own", "bare", "part")} for x in "cs")
    return pairs.select("c_custkey", "s_suppkey", F.round(tt.parts_score(u, v, tt.bits_jaccard(F.col("c_set"), F.col("s_set"))), 9).alias("score"))


@query("""WITH e AS (SELECT p_partkey, string_split(lower(p_name), ' ')[1] AS a, string_split(lower(p_name), ' ')[2] AS b FROM part),
x AS (SELECT DISTINCT unnest([a[1], a[2]]) AS ch, unnest([b[1:2], b[2:3]]) AS syllable FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY ch) AS n_syllables FROM x WHERE ch NOT IN ('z')) SELECT * FROM n WHERE n_syllables <= 12""")
def phonetic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and their syllables by position; here the first letters of one word and the letter pairs of another."""
    w = F.split(F.lower("p_name"), " ")
    e = table(spark, sf_dir, "part").select(w[0].alias("a"), w[1].alias("b"))
    chars = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.substring(F.col("a"), i, F.lit(1)))
    syl = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.substring(F.col("b"), i, F.lit(2)))
    return phonetic.phonetic_table(e.select(chars.alias("characters"), syl.alias("syllables")), "z", 12)


@query("SELECT n_nationkey AS number, min(s_name) AS text_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def id_resolution_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("number"), F.col("s_name").alias("text_id"))
    return concordance.resolve_first(n, s)


@query("SELECT n_nationkey AS number, s_name AS text_id FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def id_resolution_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("number"), F.col("s_name").alias("text_id"))
    return concordance.resolve_all(n, s)


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS t, p_brand AS brand, p_size AS size, p_type AS type FROM part WHERE p_size <= 25),
b AS (SELECT p_partkey AS ref, p_name AS t, p_brand AS brand, p_size - 25 AS size, p_type AS type FROM part WHERE p_size > 25),
m1 AS (SELECT id, min(ref) AS ref, 'title' AS method FROM a JOIN b ON a.t = b.t AND a.brand = b.brand AND a.size = b.size GROUP BY id),
m2 AS (SELECT id, min(ref) AS ref, 'title_brand' AS method FROM a JOIN b ON a.t = b.t AND a.brand = b.brand WHERE id NOT IN (SELECT id FROM m1) GROUP BY id),
m3 AS (SELECT id, min(ref) AS ref, 'size' AS method FROM a JOIN b ON a.brand = b.brand AND a.size = b.size AND a.type = b.type WHERE id NOT IN (SELECT id FROM m1 UNION ALL SELECT id FROM m2) GROUP BY id)
SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3""")
def waterfall_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts against large ones, by ever weaker keys; each step sees what no earlier one matched."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    left = p.where("size <= 25").withColumnRenamed("p_partkey", "id")
    right = p.where("size > 25").withColumn("size", F.col("size") - 25).withColumnRenamed("p_partkey", "ref")
    return concordance.waterfall(left, right, [("title", ["t", "brand", "size"]), ("title_brand", ["t", "brand"]), ("size", ["brand", "size", "type"])])
