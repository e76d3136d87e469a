import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions import titles as tt
from loomtext.operators import candidates, grams, intervals, phonetic, scoring, title_match
from loomtext.params import ScoreParams, TitleParams

P = ScoreParams()


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("word", "parts"), [("gate", ["ga", "te"]), ("bodhi", ["bod", "hi"]), ("gandharva", ["gand", "har", "va"]), ("vajra", ["vaj", "ra"]), ("svāhā", ["sva", "ha"]), ("", [])])
def test_syllables(word, parts):
    assert phonetic.syllables(word) == parts


def test_normalisation_keeps_the_ranges(spark):
    assert value(spark, tx.keep_only(F.lit("a一\U00020000。𫝀b鿿"))) == "一\U00020000𫝀鿿"
    assert value(spark, tx.words(F.lit(" Ein, zwei_Drei!\n4 "))) == ["ein", "zwei", "drei", "4"]
    assert value(spark, tx.words(F.lit(None).cast("string"))) == []


def test_grams_of_short_texts(spark):
    assert value(spark, tx.grams(F.array(*map(F.lit, "abc")), 5)) == []
    assert value(spark, tx.grams(F.array(*map(F.lit, "abcdef")), 5, "")) == ["abcde", "bcdef"]
    assert value(spark, tx.characters(F.lit(""))) == []


def test_stop_grams_of_a_small_corpus_are_all(spark):
    docs = spark.createDataFrame([(i, f"same five words in all {i}") for i in range(5)], "id long, text string")
    made = grams.gram_table(docs, "id", "text", 5)
    assert grams.stop_grams(grams.document_frequency(made), docs, 0.05).count() == grams.document_frequency(made).count()
    assert grams.stop_grams(grams.document_frequency(made), docs, 1.0).count() == 0


def test_size_ratio_is_inclusive(spark):
    text = "一二三四五六七八九十"
    rows = [("d", text, 10), ("s", text * 2, 20), ("t", text + "甲乙丙丁戊己庚辛壬", 19)]
    g = grams.gram_table(spark.createDataFrame(rows, "id string, text string, n int"), "id", "text", 5, tx.CJK_CORPUS).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "id string, n int"), "id")
    found = candidates.containment(g, g, 0.1, (F.col("d.id") != F.col("s.id")) & (F.col("s.n") >= 2.0 * F.col("d.n")))
    assert [tuple(r) for r in found.collect()] == [("d", "s", 6, 6, 1.0)]


def test_crossrefs_put_the_shorter_first_and_ties_by_id(spark):
    rows = [("b", 5, "k"), ("a", 5, "k"), ("c", 3, "k"), ("d", 9, "other")]
    got = sorted(map(tuple, candidates.crossref_pairs(spark.createDataFrame(rows, "id string, n_chars int, key string")).collect()))
    assert got == [("a", "b"), ("c", "a"), ("c", "b")]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 6, 20), (1, 130, 140), (2, 3, 4), (1, 1, 2)], "k int, a int, b int")
    assert {r["k"]: r["n"] for r in intervals.merged_length(df, ["k"], "a", "b", "n").collect()} == {1: 30, 2: 1}
    assert {r["k"]: r["n"] for r in intervals.regions(df, ["k"], "a", "b", 100, "n").collect()} == {1: 2, 2: 1}
    assert sorted(map(tuple, intervals.merged(df, ["k"], "a", "b").collect())) == [(1, 0, 20), (1, 130, 140), (2, 3, 4)]


@pytest.mark.parametrize(
    ("effective", "ratio", "average", "name"),
    [(0.0999, 9, 99, "no_relationship"), (0.1, 9, 99, "shared_tradition"), (0.3, 2.99, 99, "retranslation"), (0.8, 3.0, 15.0, "excerpt"), (0.8, 3.0, 14.9, "digest"), (0.79, 3, 99, "digest"), (0.3, 3, 10, "digest"), (0.3, 3, 9.9, "commentary")],
)
def test_classes(spark, effective, ratio, average, name):
    assert value(spark, scoring.classify(F.lit(effective), F.lit(float(ratio)), F.lit(float(average)), P)) == name


def test_confidence_and_coverage(spark):
    got = value(spark, scoring.confidence(F.lit(0.9), F.lit(50), F.lit(100), F.lit(8.0), F.lit(3), F.lit(True), F.lit(10.0), P))
    assert math.isclose(got, 0.35 * 0.9 + 0.2 * 0.5 + 0.1 * 0.5 + 0.1 * 0.3 + 0.15 + 0.1 * 0.5)
    assert math.isclose(value(spark, scoring.effective_coverage(F.lit(1.0), F.lit(0.5), P)), 0.9)
    assert value(spark, scoring.size_ratio(F.lit(0), F.lit(5))) == 1.0


def test_title_functions(spark):
    assert value(spark, tt.normal_title(F.lit("Prajñā­pāramitā-Hṛdaya!"))) == "prajnaparamitahrdaya"
    assert value(spark, tt.normal_title(F.lit("Vajra-cchedikā"))) == value(spark, tt.normal_title(F.lit("Vajracchedikā")))
    assert value(spark, tt.title_tokens(F.lit("Vajra-cchedikā nāma a sūtra"))) == ["vajra", "cchedika", "nama", "sutra"]
    assert value(spark, tt.decoded(F.lit("Vajracchedik&#257;praj&ntilde;&#257;"))) == "Vajracchedikāprajñā"
    assert value(spark, tt.levenshtein_ratio(F.lit(""), F.lit(""))) == 1.0
    assert value(spark, tt.most_edits(F.lit("x" * 20), F.lit("y"), 0.9)) == int(20 * (1 - 0.9))
    p = ("佛說", "大")
    score = lambda a, b: value(spark, tt.title_score(F.lit(a), F.lit(b), p))
    assert score("心經", "心經") == 1.0 and score("佛說心經", "心經") == 0.95 and score("般若心經", "心經") == 0.9
    assert score("", "") == 0.0 and score("abc", "abc") == 0.0 and score("心經 a", "心-經") == 1.0
    assert score("佛說大", "甲乙丙") == 0.0 and math.isclose(score("甲乙丙丁", "甲乙丁戊"), 3 / 5)


def test_title_passes_and_precedence(spark):
    left = title_match.normalised(spark.createDataFrame([("a", "Lotus Sutra"), ("b", "heart of perfect wisdom"), ("c", "diamond cutter discourse"), ("d", "!!")], "id string, title string"))
    right = title_match.normalised(spark.createDataFrame([(1, "lotus sutra"), (2, "perfect wisdom of heart"), (3, "diamond cuter discourse"), (4, "something else")], "id int, title string"))
    got = {(r["left_id"], r["right_id"]): r["kind"] for r in title_match.match(left, right, TitleParams()).collect()}
    assert got == {("a", 1): "exact", ("b", 2): "token", ("c", 3): "fuzzy"}


def test_fuzzy_titles_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeinstr") for _ in range(n)) for n in (5, 9, 10, 11, 20, 40, 80, 200, 1300)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(([], ["x"], [t[i], "y"]))
        return "".join(t)

    titles = [edited(t, k) for t in base for k in {0, 1, 2, len(t) // 12, len(t) // 9}]
    make = lambda rows: title_match.normalised(spark.createDataFrame(list(enumerate(rows)), "id int, title string"))
    distance = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(F.levenshtein("a", "b")).first()[0]
    pairs = spark.createDataFrame([(a, b) for a in set(base) for b in set(titles) if a != b and len(a) >= 5 and len(b) >= 5], "l string, r string").withColumn("d", F.levenshtein("l", "r"))
    for ratio in (0.9, 0.8):
        want = {(r["l"], r["r"]) for r in pairs.collect() if r["d"] <= int(max(len(r["l"]), len(r["r"])) * (1 - ratio)) and 1 - r["d"] / max(len(r["l"]), len(r["r"])) >= ratio}
        got = {(r["l"], r["r"]) for r in title_match.few_edits(make(base), make(titles), ratio, 5).collect()}
        assert got == want and any(len(a) > 1000 for a, _ in got)
    assert distance("kitten", "sitting") == 3


def test_entry_pairs_are_listed_by_kind(spark):
    left = title_match.normalised(spark.createDataFrame([("a", "diamond cutter discourse"), ("a", "discourse of diamond cutter"), ("b", "Vajra-cchedik&#257;")], "id string, title string"))
    right = title_match.normalised(spark.createDataFrame([(1, "diamond cuter discourse"), (1, "cutter discourse diamond"), (2, "Vajracchedikā"), (2, "vajra cchedika nama")], "id int, title string"))
    got = sorted((r["left_id"], r["right_id"], r["kind"]) for r in title_match.match(left, right, TitleParams()).collect())
    assert got == [("a", 1, "fuzzy"), ("a", 1, "token"), ("b", 2, "exact")]


def test_sections(spark):
    df = spark.createDataFrame([(1, 2000, "fuzzy"), (1, 2000, "exact"), (30, 5, "token"), (30, 1109, "token")], "v int, t int, k string")
    assert [r[0] for r in df.select(title_match.section_mismatch(F.col("v"), F.col("t"), F.col("k"))).collect()] == [True, False, True, False]


def test_dense_regions_against_loops(spark):
    texts = ["aaxaaxaaxxxxaaaaaa", "xxxx", "", "aaaaaaaaaa", "a" * 6 + "x" * 20 + "a" * 7]
    window, least, shortest = 6, 4, 6
    want = set()
    for i, t in enumerate(texts):
        starts = [p for p in range(len(t) - window + 1) if sum(c == "a" for c in t[p : p + window]) >= least]
        spans = []
        for p in starts:
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + window
            else:
                spans.append([p, p + window])
        want |= {(i, a, b) for a, b in spans if b - a >= shortest}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    regions = phonetic.dense_regions(df, "a", window, least, shortest)
    assert set(map(tuple, regions.collect())) == want
    got = phonetic.syllable_grams(df, regions, {"a": "A"}, 3)
    assert {r["id"] for r in got.collect()} == {i for i, *_ in want} and {r["gram"] for r in got.collect()} == {"AAA"}


def test_phonetic_table(spark):
    rows = [(list("ab"), ["x", "y"]), (list("ac"), ["z", "w"]), (list("abc"), ["x", "y"]), (list("qa"), ["k", "v"]), (["m"], ["n"])] + [(["e", "f"], [f"s{i}", "t"]) for i in range(6)]
    got = {(r["ch"], r["syllable"]) for r in phonetic.phonetic_table(spark.createDataFrame(rows, "characters array<string>, syllables array<string>"), "q", 5).collect()}
    assert got == {("a", "x"), ("a", "z"), ("a", "v"), ("b", "y"), ("c", "w"), ("f", "t")}
    assert value(spark, phonetic.equivalent(F.lit("a"), F.lit("b"), F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))))
    assert not value(spark, phonetic.equivalent(F.lit("a"), F.lit("b"), F.array(F.lit("x")), F.lit(None).cast("array<string>")))


def test_multi_source_needs_a_gain(spark):
    rows = [("d", "a", 0, 50, 0.0), ("d", "b", 50, 90, 0.0), ("e", "a", 0, 50, 0.0), ("e", "b", 0, 48, 0.0), ("f", "a", 0, 50, 0.0)]
    seg = spark.createDataFrame(rows, "digest_id string, source_id string, start int, stop int, phonetic_fraction double")
    lengths = spark.createDataFrame([(d, 100) for d in "def"], "digest_id string, length int")
    assert [tuple(r) for r in scoring.multi_source(seg, lengths, 0.1, P).collect()] == [("d", 2, 0.5, 0.9)]
