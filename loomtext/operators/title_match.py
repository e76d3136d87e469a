"""Title matching in three passes: equal, sharing tokens, few edits; all by equi-joins on what similar titles must share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import titles as tt
from ..params import TitleParams


def normalised(entries: DataFrame) -> DataFrame:
    """(id, title) with ``norm``; entities are decoded, and entries whose title is nothing but punctuation are dropped."""
    plain = entries.withColumn("title", F.when(F.col("title").contains("&"), tt.decoded(F.col("title"))).otherwise(F.col("title")))
    return plain.withColumn("norm", tt.normal_title(F.col("title"))).where("norm <> ''")


def exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct normal titles, here equal ones: (l, r, score, kind)."""
    both = left.select("norm").distinct().join(right.select("norm").distinct(), "norm")
    return both.select(F.col("norm").alias("l"), F.col("norm").alias("r"), F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))


def _rarest(each: DataFrame, keep: Column, title: str, *order: str) -> DataFrame:
    """Of (part, title, size, ...) the rarest parts of each title, as many as ``keep`` (over ``size``) says.

    Two titles that are alike enough must have one of these in common, as every title orders its parts the same way.
    """
    at = F.row_number().over(Window.partitionBy(title).orderBy("df", "part", *order))
    return each.withColumn("_at", at).where(F.col("_at") <= keep).drop("_at", "df")


def shared_tokens(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of different normal titles whose token sets have the Jaccard ``least`` or more.

    A normal title has the tokens of the first title, in code-point order, that gives it. Only names and sizes of titles
    travel with their rarest tokens; the token sets of candidates are fetched for them.
    """
    own = [side.groupBy("norm").agg(F.min("title").alias("title")).select("norm", tt.title_tokens(F.col("title")).alias("tokens")) for side in (left, right)]
    each = [side.select("norm", F.size("tokens").alias("size"), F.explode("tokens").alias("part")) for side in own]
    frequency = each[0].unionByName(each[1]).groupBy("part").agg(F.count("*").alias("df"))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    l, r = (_rarest(x.join(frequency, "part"), keep, "norm") for x in each)
    l, r = l.select(F.col("norm").alias("l"), F.col("size").alias("a"), "part"), r.select(F.col("norm").alias("r"), F.col("size").alias("b"), "part")
    pairs = l.join(r, "part").where((F.col("l") != F.col("r")) & (F.least("a", "b") >= F.greatest("a", "b") * least - 1e-9)).select("l", "r").distinct()
    full = pairs.join(own[0].toDF("l", "lt"), "l").join(own[1].toDF("r", "rt"), "r")
    return full.withColumn("score", tt.jaccard(F.col("lt"), F.col("rt"))).where(F.col("score") >= least).select("l", "r", "score", F.lit("token").alias("kind"))


def gram_length(ratio: float, least_length: int) -> int:
    """The longest of 3, 2 and 1 of which some gram is sure to outlive the edits that titles of any length may have."""
    slack = (1 - ratio) / ratio
    return next(q for q in (3, 2, 1) if q == 1 or all(n - q + 1 > q * math.floor(n * slack + 1e-9) for n in range(least_length, 4000)) and q * slack < 1)


def few_edits(left: DataFrame, right: DataFrame, ratio: float, least_length: int, known: DataFrame | None = None) -> DataFrame:
    """Pairs of different normal titles of a Levenshtein ratio of ``ratio`` or more, without those of ``known`` (l, r).

    One edit changes at most q of a title's q-grams, so of a title that allows d edits the q * d + 1 rarest grams have
    one that the other title's rarest have too, at most d places off. Such pairs are then verified.
    """
    q, slack = gram_length(ratio, least_length), (1 - ratio) / ratio
    own = [side.select(F.xxhash64("norm").alias("key"), "norm", F.length("norm").alias("size")).distinct().where(F.col("size") >= least_length) for side in (left, right)]
    places = F.sequence(F.lit(1), F.col("size") - q + 1)
    each = [x.where(F.col("size") >= q).select("key", "norm", "size", F.explode(places).alias("at")).withColumn("part", F.substring(F.col("norm"), F.col("at"), F.lit(q))).drop("norm") for x in own]
    frequency = each[0].unionByName(each[1]).groupBy("part").agg(F.count("*").alias("df"))
    l, r = (_rarest(x.join(frequency, "part"), q * F.floor(F.col("size") * F.lit(slack) + 1e-9) + 1, "key", "at") for x in each)
    l, r = l.toDF("part", "lk", "a", "i"), r.toDF("part", "rk", "b", "j")
    bound = (F.greatest("a", "b") * F.lit(1 - ratio)).cast("int")
    met = l.join(r, "part").where((F.abs(F.col("a") - F.col("b")) <= bound) & (F.abs(F.col("i") - F.col("j")) <= bound))
    # titles travel as hashed keys; the titles themselves are fetched for the candidates and decide
    pairs = met.select("lk", "rk").distinct().join(own[0].select(F.col("key").alias("lk"), F.col("norm").alias("l")), "lk").join(own[1].select(F.col("key").alias("rk"), F.col("norm").alias("r")), "rk")
    pairs = pairs.select("l", "r").where("l <> r")
    pairs = pairs if known is None else pairs.join(known.select("l", "r"), ["l", "r"], "left_anti")
    scored = pairs.withColumn("_most", tt.most_edits(F.col("l"), F.col("r"), ratio)).withColumn("_d", F.expr("levenshtein(l, r, _most)")).where("_d >= 0")
    scored = scored.withColumn("score", 1 - F.col("_d") / F.greatest(F.length("l"), F.length("r")))
    return scored.where(F.col("score") >= ratio).select("l", "r", "score", F.lit("fuzzy").alias("kind"))


def match(left: DataFrame, right: DataFrame, p: TitleParams) -> DataFrame:
    """(left_id, right_id, kind, score): the first pass that finds a pair of titles names it, whatever later ones score.

    Entries may have several titles: an entry pair is listed once for each kind, with its best score, and an equal
    title hides the weaker kinds.
    """
    equal = exact(left, right)
    shared = shared_tokens(left, right, p.token_jaccard).persist()  # read twice; as large as the titles' pairs, not the entries'
    found = equal.unionByName(shared).unionByName(few_edits(left, right, p.fuzzy_ratio, p.fuzzy_least_length, shared))
    l, r = (_entries(side) for side in (left, right))
    # titles with many entries are spread before each of these meets the other side's
    half, of_one = found.join(l.toDF("left_id", "l", "_several"), "l").drop("l"), F.col("_several") == F.lit(False)
    with_right = lambda own, those: own.drop("_several").join(those.select(F.col("id").alias("right_id"), F.col("norm").alias("r")), "r").select("left_id", "right_id", "kind", "score")
    # a pair of entries with one title each comes of one pair of titles, which has one kind
    plain = with_right(half.where(of_one), r.where(of_one))
    entries = with_right(half.where("_several"), r).unionByName(with_right(half.where(of_one), r.where("_several")))
    best = entries.groupBy("left_id", "right_id", "kind").agg(F.max("score").alias("score"))
    has_equal = F.max((F.col("kind") == "exact").cast("int")).over(Window.partitionBy("left_id", "right_id"))
    return plain.unionByName(best.withColumn("_equal", has_equal).where("_equal = 0 or kind = 'exact'").drop("_equal"))


def _entries(side: DataFrame) -> DataFrame:
    """(id, norm, several): the different titles of each entry, and whether it has more than one."""
    one = side.groupBy("id").agg((F.min("norm") != F.max("norm")).alias("_several"))
    return side.select("id", "norm").distinct().join(one, "id").select("id", "norm", "_several")


def validated(matches: DataFrame, concordance: DataFrame) -> DataFrame:
    """Adds ``status`` to (text_id, toh, volume, kind): filtered, new, validated or contradicted by (text_id, toh) known so far.

    Negative numbers are rows of a catalogue without one and are left out; a section mismatch is filtered before the
    concordance is asked; ``known_toh`` lists what contradicts.
    """
    known = concordance.groupBy("text_id").agg(F.array_sort(F.collect_set("toh")).alias("known_toh"))
    joined = matches.where("toh >= 0").join(known, "text_id", "left")
    mismatch = (F.col("toh") > 0) & section_mismatch(F.col("volume"), F.col("toh"), F.col("kind"))
    status = F.when(mismatch, "filtered").when(F.col("known_toh").isNull(), "new").when(F.array_contains("known_toh", F.col("toh")), "validated").otherwise("contradicted")
    return joined.withColumn("status", status).withColumn("known_toh", F.when(F.col("status") == "contradicted", F.col("known_toh")))


def section_mismatch(volume: Column, toh: Column, kind: Column) -> Column:
    """Inexact matches between sections of the two canons that do not correspond."""
    return (kind != "exact") & ((volume.between(1, 21) & (toh >= 1109)) | (volume.between(25, 32) & (toh <= 1108)))


def demoted(volume: Column, toh: Column, text: str) -> Column:
    """Matches in the commentary section of a text that has one in the scripture section too."""
    has = F.max(toh.between(1, 1108)).over(Window.partitionBy(text))
    return volume.between(1, 21) & (toh >= 1109) & has
