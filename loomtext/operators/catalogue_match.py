"""Candidates between two catalogues by several signals: catalogue numbers, titles of one script, titles of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles as tt
from . import title_match

SIGNALS = ("number", "title", "exact", "token", "fuzzy")


def candidates(entries: DataFrame, texts: DataFrame, sections: DataFrame, numbers: DataFrame, prefixes: tuple[str, ...], alphabet: str, token: float = 0.5, fuzzy: float = 0.80, least_length: int = 8) -> DataFrame:
    """(entry_id, text_id, signal, score): one row a pair, by the first signal that finds it.

    ``entries``: (entry_id, section, number, title, other_title) without a known text; ``texts``: (text_id, volume, title,
    other_title); ``sections``: (section, low, high) volumes where texts of a section stand, anywhere for a section that it
    lacks; ``numbers``: (number, text_id). Titles of ``alphabet`` are compared within the section's volumes, on a character that both
    have; other titles are equal, share ``token`` of their words, or ``fuzzy`` of their letters.
    """
    by_number = entries.where("number is not null").select("entry_id", "number").join(numbers, "number").select("entry_id", "text_id", F.lit(0).alias("rank"), F.lit(1.0).alias("score"))
    everywhere = entries.select("section").distinct().join(sections.select("section").distinct(), "section", "left_anti").withColumns({"low": F.lit(1), "high": F.lit(55)})
    places = sections.unionByName(everywhere).select("section", F.explode(F.sequence("low", "high")).alias("volume")).distinct()
    characters = lambda c: F.explode(F.array_distinct(F.split(tt.keep_only(c, alphabet), "")))
    l = entries.where("title is not null").join(places, "section").select("entry_id", "volume", "title", characters(F.col("title")).alias("ch"))
    r = texts.where("title is not null").select("text_id", "volume", F.col("title").alias("own"), characters(F.col("title")).alias("ch"))
    met = l.join(r, ["volume", "ch"]).select("entry_id", "text_id", "title", "own").distinct()
    by_title = met.select("entry_id", "text_id", F.lit(1).alias("rank"), tt.title_score(F.col("title"), F.col("own"), prefixes, alphabet).alias("score")).where("score > 0")
    sides = [title_match.normalised(x.where("other_title is not null").select(F.col(i).alias("id"), F.col("other_title").alias("title"))) for x, i in ((entries, "entry_id"), (texts, "text_id"))]
    found = title_match.exact(*sides).unionByName(title_match.shared_tokens(*sides, token)).unionByName(title_match.few_edits(*sides, fuzzy, least_length))
    by_other = found.join(sides[0].select(F.col("id").alias("entry_id"), F.col("norm").alias("l")), "l").join(sides[1].select(F.col("id").alias("text_id"), F.col("norm").alias("r")), "r")
    rank = F.when(F.col("kind") == "exact", 2).when(F.col("kind") == "token", 3).otherwise(4)
    every = by_number.unionByName(by_title).unionByName(by_other.select("entry_id", "text_id", rank.alias("rank"), "score"))
    best = every.groupBy("entry_id", "text_id").agg(F.min_by(F.struct("rank", "score"), F.struct("rank", -F.col("score"))).alias("b"))
    return best.select("entry_id", "text_id", F.element_at(F.array(*map(F.lit, SIGNALS)), F.col("b.rank") + 1).alias("signal"), F.round("b.score", 3).alias("score"))
