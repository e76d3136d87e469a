"""Classification, confidence, multi-source digests and ranking of aligned pairs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ScoreParams
from . import intervals


def effective_coverage(coverage: Column, phonetic_fraction: Column, p: ScoreParams) -> Column:
    return coverage * (1 - phonetic_fraction) + coverage * phonetic_fraction * p.phonetic_weight


def size_ratio(digest_length: Column, source_length: Column) -> Column:
    return F.when(digest_length == 0, F.lit(1.0)).otherwise(source_length / digest_length)


def classify(effective: Column, ratio: Column, average_segment: Column, p: ScoreParams) -> Column:
    return (
        F.when(effective < p.shared_coverage, "no_relationship")
        .when(effective < p.digest_coverage, "shared_tradition")
        .when(ratio < p.retranslation_ratio, "retranslation")
        .when((effective >= p.excerpt_coverage) & (average_segment >= p.excerpt_avg), "excerpt")
        .when(average_segment >= p.digest_avg, "digest")
        .otherwise("commentary")
    )


def confidence(coverage: Column, longest: Column, digest_length: Column, ratio: Column, regions: Column, crossref: Column, average_segment: Column, p: ScoreParams) -> Column:
    """Weighted sum of bounded signals, unrounded."""
    share = F.when(digest_length > 0, longest / digest_length).otherwise(F.lit(0.0))
    parts = (
        coverage,
        share,
        F.least((regions - 1) / 4, F.lit(1.0)),
        F.least(F.log2(F.greatest(ratio, F.lit(1.0))) / 10, F.lit(1.0)),
        F.when(crossref, 1.0).otherwise(0.0),
        F.least(average_segment / 20, F.lit(1.0)),
    )
    total = F.lit(0.0)
    for w, x in zip(p.weights, parts):
        total = total + w * x
    return total


def segment_statistics(segments: DataFrame, region_gap: int) -> DataFrame:
    """Of each pair's segments: digest length and covered length, averages, the longest, phonetic share, source regions.

    ``segments``: those of :func:`alignment.align_pairs`. A pair of which nothing matches has averages and shares of 0.
    """
    pair = ["digest_id", "source_id"]
    n = F.col("digest_end") - F.col("digest_start")
    matched, phonetic = F.col("match_type") != "novel", F.col("match_type") == "phonetic"
    own = segments.groupBy(*pair).agg(
        F.max("digest_end").alias("digest_length"), F.sum(F.when(matched, n).otherwise(0)).alias("matched"), F.coalesce(F.avg(F.when(matched, n)), F.lit(0.0)).alias("avg_segment_length"),
        F.coalesce(F.max(F.when(matched, n)), F.lit(0)).alias("longest_segment"), F.sum(F.when(phonetic, n).otherwise(0)).alias("phonetic"), F.count_if(phonetic).alias("n_phonetic"), F.count_if(matched).alias("n_matched"),
    )
    some = segments.where(matched)
    spanned = intervals.merged_length(some, pair, "source_start", "source_end", "source_span")
    regions = intervals.regions(some, pair, "source_start", "source_end", region_gap, "num_source_regions")
    out = own.join(spanned, pair, "left").join(regions, pair, "left").fillna({"source_span": 0, "num_source_regions": 0})
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({"coverage": share("matched", "digest_length"), "phonetic_fraction": share("phonetic", "matched")}).withColumn("novel_fraction", 1 - F.col("coverage"))


def score_pairs(statistics: DataFrame, digests: DataFrame, sources: DataFrame, crossrefs: DataFrame, p: ScoreParams) -> DataFrame:
    """Classified and weighed relations of aligned pairs whose two texts are known, those without one left out.

    ``statistics``: rows of :func:`segment_statistics`; ``digests`` and ``sources``: (id, length) of main texts;
    ``crossrefs``: (digest_id, source_id) of cross references.
    """
    d, s = digests.toDF("digest_id", "d_len"), sources.toDF("source_id", "s_len")
    marked = crossrefs.select("digest_id", "source_id").distinct().withColumn("crossref", F.lit(True))
    f = statistics.join(d, "digest_id").join(s, "source_id").join(marked, ["digest_id", "source_id"], "left").withColumn("crossref", F.coalesce("crossref", F.lit(False)))
    f = f.withColumn("effective", effective_coverage(F.col("coverage"), F.col("phonetic_fraction"), p)).withColumn("size_ratio", size_ratio(F.col("d_len"), F.col("s_len")))
    conf = confidence(F.col("effective"), F.col("longest_segment"), F.col("d_len"), F.col("size_ratio"), F.col("num_source_regions"), F.col("crossref"), F.col("avg_segment_length"), p)
    f = f.withColumn("classification", classify(F.col("effective"), F.col("size_ratio"), F.col("avg_segment_length"), p)).withColumn("confidence", F.bround(conf, 4))
    return f.where("classification <> 'no_relationship'")


def multi_source(segments: DataFrame, lengths: DataFrame, least: float, p: ScoreParams) -> DataFrame:
    """Digests whose sources together cover clearly more than the best alone.

    ``segments``: (digest_id, source_id, start, stop, phonetic_fraction); ``lengths``: (digest_id, length). The union is
    raw coverage, the best single one is discounted for phonetic matches; the gain is asked of the two as they are.
    """
    pair = ["digest_id", "source_id"]
    single = intervals.merged_length(segments, pair, "start", "stop", "covered").join(segments.groupBy(*pair).agg(F.max("phonetic_fraction").alias("pf")), pair)
    single = single.join(lengths, "digest_id").withColumn("coverage", F.col("covered") / F.col("length")).where(F.col("coverage") >= least)
    single = single.withColumn("effective", effective_coverage(F.col("coverage"), F.col("pf"), p))
    best = single.groupBy("digest_id").agg(F.count("*").alias("n_sources"), F.max("effective").alias("best_coverage")).where("n_sources >= 2")
    own = segments.join(single.select(*pair), pair, "left_semi")
    union = intervals.merged_length(own, ["digest_id"], "start", "stop", "covered").join(lengths, "digest_id")
    out = best.join(union, "digest_id").withColumn("combined_coverage", F.col("covered") / F.col("length"))
    return out.where(F.col("combined_coverage") > F.col("best_coverage") * p.multi_source_gain).select("digest_id", "n_sources", "best_coverage", "combined_coverage")


def source_clusters(scores: DataFrame, least: int = 2) -> DataFrame:
    """Sources with several excerpts or digests: (source_id, n, digests)."""
    own = scores.where(F.col("classification").isin("excerpt", "digest"))
    out = own.groupBy("source_id").agg(F.count("*").alias("n"), F.concat_ws(";", F.array_sort(F.collect_set(F.col("digest_id").cast("string")))).alias("digests"))
    return out.where(F.col("n") >= least)


def not_of_each_other(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Expected strangers (digest_id, source_id): FAIL where either is scored as an excerpt or a digest of the other."""
    own = scores.where(F.col("classification").isin("excerpt", "digest")).select("digest_id", "source_id", F.lit(True).alias("_hit"))
    there = pairs.join(own, ["digest_id", "source_id"], "left").withColumnRenamed("_hit", "_there")
    back = there.join(own.toDF("source_id", "digest_id", "_back"), ["digest_id", "source_id"], "left")
    return back.select("digest_id", "source_id", F.when(F.coalesce("_there", "_back").isNull(), "PASS").otherwise("FAIL").alias("status")).distinct()


def ground_truth(expected: DataFrame, scores: DataFrame) -> DataFrame:
    """Expected pairs (digest_id, source_id, expected_class, least_coverage) and whether the scores agree."""
    found = expected.join(scores.select("digest_id", "source_id", "classification", "effective"), ["digest_id", "source_id"], "left")
    ok = (F.col("classification") == F.col("expected_class")) & (F.col("effective") >= F.col("least_coverage"))
    return found.select("digest_id", "source_id", "expected_class", F.coalesce("classification", F.lit("missing")).alias("found"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))
