"""Titles in many pairs: prepared once, dealt over many tasks, with the scores of arrays of characters."""

import random

from pyspark.sql import functions as F

from loomtext.functions import titles as tt
from loomtext.plans import titles

DATA = "/root/testdata/sf0.001"


def test_sets_as_bits_score_like_arrays(spark):
    rng = random.Random(4)
    title = lambda: "".join(rng.choice(("Pre#", "x", "A", "9", "0", "-", "z", "", "b")) for _ in range(rng.randrange(0, 7)))
    pairs = spark.createDataFrame([(title(), title()) for _ in range(400)], "a string, b string")
    score = lambda alphabet: tt.title_score(F.col("a"), F.col("b"), ("Pre#",), alphabet)
    bits, arrays = "A-Za-z0-9", "A-Za-z0-9\\p{Lo}"  # the second is no list of letters, though as many of these titles
    assert tt._letters(bits) and tt._letters(arrays) is None
    got = pairs.select("a", "b", score(bits).alias("x"), score(arrays).alias("y")).collect()
    assert [r for r in got if r["x"] != r["y"]] == [] and len({r["x"] for r in got}) > 4


def test_pairs_of_a_nation_are_dealt(spark):
    got = titles.cjk_title_score(spark, DATA)
    used = got.select(F.spark_partition_id().alias("part")).distinct().count()
    assert got.count() > 0 and used > 8


def test_pairs_of_entries_are_not_dealt_again(spark):
    from test_reuse_growth import records

    from loomtext.operators import title_match
    from loomtext.params import TitleParams

    n = 250
    left = [(i, "heart of perfect wisdom") for i in range(n)] + [(n, "lotus sutra"), (n, "diamond cutter discourse")]
    right = [(i, "perfect wisdom of heart") for i in range(n)] + [(n, "Lotus Sutra"), (n, "diamond cuter discourse"), (n, "heart of perfect wisdom")]
    sides = [title_match.normalised(spark.createDataFrame(x, "id int, title string")) for x in (left, right)]
    before = records(spark)
    got = [tuple(r) for r in title_match.match(*sides, TitleParams()).select("left_id", "right_id", "kind").collect()]
    assert sorted(got) == sorted([(i, j, "token") for i in range(n) for j in range(n)] + [(n, n, "exact")] + [(i, n, "exact") for i in range(n)])
    assert records(spark) - before < n * n / 4
