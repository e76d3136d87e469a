"""Scoring queries. Features of pairs are derived from orders so that every rule and boundary occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..params import ScoreParams
from .registry import query, table

P = ScoreParams()

SCORES = """
f AS (SELECT o_custkey AS digest_id, o_orderkey % 97 AS source_id, o_orderkey AS k,
    CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 AS coverage, CAST(o_custkey % 5 AS DOUBLE) / 10 AS pf, CAST(o_orderkey % 40 AS DOUBLE) / 2 AS avg_seg,
    o_custkey % 60 AS longest, o_custkey % 200 AS d_len, (o_custkey % 200) * (1 + o_orderkey % 12) AS s_len, 1 + o_orderkey % 7 AS regions, o_orderstatus = 'F' AS xref FROM orders),
e AS (SELECT *, coverage * (1 - pf) + coverage * pf * 0.8 AS effective, CASE WHEN d_len = 0 THEN 1.0 ELSE CAST(s_len AS DOUBLE) / d_len END AS ratio FROM f),
c AS (SELECT *, CASE WHEN effective < 0.1 THEN 'no_relationship' WHEN effective < 0.3 THEN 'shared_tradition' WHEN ratio < 3 THEN 'retranslation'
    WHEN effective >= 0.8 AND avg_seg >= 15 THEN 'excerpt' WHEN avg_seg >= 10 THEN 'digest' ELSE 'commentary' END AS classification,
    0.0 + 0.35 * effective + 0.20 * (CASE WHEN d_len > 0 THEN CAST(longest AS DOUBLE) / d_len ELSE 0 END) + 0.10 * least((regions - 1) / 4, 1.0)
    + 0.10 * least(log2(greatest(ratio, 1.0)) / 10, 1.0) + 0.15 * (CASE WHEN xref THEN 1.0 ELSE 0.0 END) + 0.10 * least(avg_seg / 20, 1.0) AS confidence FROM e)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    f = table(spark, sf_dir, "orders").select(
        k.alias("digest_id"), (o % 97).alias("source_id"), o.alias("k"), ((o * 37 % 101).cast("double") / 100).alias("coverage"), ((k % 5).cast("double") / 10).alias("pf"),
        ((o % 40).cast("double") / 2).alias("avg_seg"), (k % 60).alias("longest"), (k % 200).alias("d_len"), ((k % 200) * (1 + o % 12)).alias("s_len"), (1 + o % 7).alias("regions"), (F.col("o_orderstatus") == "F").alias("xref"),
    )
    f = f.withColumn("effective", scoring.effective_coverage(F.col("coverage"), F.col("pf"), P)).withColumn("ratio", scoring.size_ratio(F.col("d_len"), F.col("s_len")))
    conf = scoring.confidence(F.col("effective"), F.col("longest"), F.col("d_len"), F.col("ratio"), F.col("regions"), F.col("xref"), F.col("avg_seg"), P)
    return f.withColumn("classification", scoring.classify(F.col("effective"), F.col("ratio"), F.col("avg_seg"), P)).withColumn("confidence", conf)


@query(f"WITH {SCORES} SELECT k, classification, round(effective, 6) AS effective, round(ratio, 6) AS ratio FROM c")
def classify_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("k", "classification", F.round("effective", 6).alias("effective"), F.round("ratio", 6).alias("ratio"))


@query(f"WITH {SCORES} SELECT k, digest_id, source_id, round(confidence, 6) AS confidence FROM c WHERE classification <> 'no_relationship'")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("classification <> 'no_relationship'").select("k", "digest_id", "source_id", F.round("confidence", 6).alias("confidence"))


@query("""WITH seg AS (SELECT l_orderkey AS digest_id, l_suppkey AS source_id, CAST(l_partkey % 150 AS BIGINT) AS a, CAST(l_partkey % 150 + l_quantity AS BIGINT) AS b, CAST(l_suppkey % 3 AS DOUBLE) / 4 AS pf FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY digest_id, source_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM seg),
one AS (SELECT digest_id, source_id, CAST(sum(greatest(0, b - greatest(a, coalesce(seen, a)))) AS DOUBLE) / 200 AS cov, max(pf) AS pf FROM m GROUP BY ALL),
ok AS (SELECT *, cov * (1 - pf) + cov * pf * 0.8 AS eff FROM one WHERE cov >= 0.1),
best AS (SELECT digest_id, count(*) AS n_sources, max(eff) AS best_coverage FROM ok GROUP BY digest_id HAVING count(*) >= 2),
own AS (SELECT seg.* FROM seg SEMI JOIN ok USING (digest_id, source_id)),
u AS (SELECT *, max(b) OVER (PARTITION BY digest_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM own),
un AS (SELECT digest_id, CAST(sum(greatest(0, b - greatest(a, coalesce(seen, a)))) AS DOUBLE) / 200 AS combined_coverage FROM u GROUP BY digest_id)
SELECT digest_id, n_sources, round(best_coverage, 6) AS best_coverage, combined_coverage FROM best JOIN un USING (digest_id) WHERE combined_coverage > best_coverage * 1.1""")
def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_partkey") % 150
    seg = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("digest_id"), F.col("l_suppkey").alias("source_id"), a.alias("start"), (a + F.col("l_quantity").cast("long")).alias("stop"), ((F.col("l_suppkey") % 3).cast("double") / 4).alias("phonetic_fraction")
    )
    lengths = seg.select("digest_id").distinct().withColumn("length", F.lit(200))
    return scoring.multi_source(seg, lengths, 0.1, P).withColumn("best_coverage", F.round("best_coverage", 6))


@query(f"WITH {SCORES} SELECT classification, count(*) AS n, CAST(count(*) FILTER (WHERE pf > 0) AS BIGINT) AS with_phonetic FROM c GROUP BY classification")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"), F.count_if(F.col("pf") > 0).alias("with_phonetic"))


@query(f"WITH {SCORES} SELECT k, digest_id, source_id, classification, round(confidence, 6) AS confidence FROM c WHERE classification <> 'no_relationship' ORDER BY round(confidence, 6) DESC, digest_id, source_id, k LIMIT 50")
def top_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(spark, sf_dir).where("classification <> 'no_relationship'").select("k", "digest_id", "source_id", "classification", F.round("confidence", 6).alias("confidence"))
    return out.orderBy(F.desc("confidence"), "digest_id", "source_id", "k").limit(50)


@query(f"WITH {SCORES} SELECT source_id, count(*) AS n, string_agg(DISTINCT CAST(digest_id AS VARCHAR), ';' ORDER BY CAST(digest_id AS VARCHAR)) AS digests FROM c WHERE classification IN ('excerpt', 'digest') GROUP BY source_id HAVING count(*) >= 2")
def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.source_clusters(scores(spark, sf_dir))


_EXPECTED = [(5, 3, "digest", 0.3), (77, 10, "excerpt", 0.8), (899, 0, "no_relationship", 0.0), (769, 1, "retranslation", 0.3), (330, 2, "shared_tradition", 0.1), (-1, 2, "digest", 0.3)]


@query(f"""WITH {SCORES}, want(digest_id, source_id, expected_class, least) AS (VALUES {', '.join(map(str, _EXPECTED))}),
one AS (SELECT digest_id, source_id, arg_min(classification, k) AS classification, arg_min(effective, k) AS effective FROM c GROUP BY digest_id, source_id)
SELECT CAST(digest_id AS BIGINT) AS digest_id, CAST(source_id AS BIGINT) AS source_id, expected_class, coalesce(classification, 'missing') AS found, CASE WHEN classification = expected_class AND effective >= least THEN 'PASS' ELSE 'FAIL' END AS status
FROM want LEFT JOIN one USING (digest_id, source_id)""")
def ground_truth_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame(_EXPECTED, "digest_id long, source_id long, expected_class string, least_coverage double")
    one = scores(spark, sf_dir).groupBy("digest_id", "source_id").agg(F.min_by("classification", "k").alias("classification"), F.min_by("effective", "k").alias("effective"))
    return scoring.ground_truth(expected, one)


@query(f"""WITH {SCORES}, hit AS (SELECT DISTINCT digest_id, source_id FROM c WHERE classification IN ('excerpt', 'digest')), p AS (SELECT DISTINCT c_custkey AS digest_id, c_nationkey AS source_id FROM customer)
SELECT digest_id, source_id, CASE WHEN (digest_id, source_id) IN (SELECT (digest_id, source_id) FROM hit) OR (source_id, digest_id) IN (SELECT (digest_id, source_id) FROM hit) THEN 'FAIL' ELSE 'PASS' END AS status FROM p""")
def stranger_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that must not be scored as digests of each other, either way."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("digest_id"), F.col("c_nationkey").cast("long").alias("source_id")).distinct()
    return scoring.not_of_each_other(pairs, scores(spark, sf_dir)).withColumn("source_id", F.col("source_id").cast("int"))


@query("""SELECT l_orderkey AS text_id, l_partkey % 20 AS ref, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total,
CASE WHEN sum(l_quantity) >= 100 THEN 0.9 WHEN sum(l_quantity) >= 40 THEN 0.7 ELSE 0.5 END AS confidence FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 20""")
def sentence_pair_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of sentence-pair counts; pairs below the minimum are dropped, the weakest tier has a value of its own."""
    total = F.sum(F.col("l_quantity").cast("long"))
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("text_id"), (F.col("l_partkey") % 20).alias("ref")).agg(total.alias("total")).where("total >= 20")
    return out.withColumn("confidence", F.when(F.col("total") >= 100, 0.9).when(F.col("total") >= 40, 0.7).otherwise(0.5))
