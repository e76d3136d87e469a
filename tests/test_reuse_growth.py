"""Text-reuse steps against loops, and that rows which only common grams would make are not made."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import candidates, grams
from loomtext.plans import reuse


def records(spark):
    """Rows that all stages of this session have put into shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def corpus(n: int = 300, common: int = 12):
    """(doc_id, text, lang, n_chars): texts of other lengths; each has one of some common passages, few have much of another."""
    rng, out = random.Random(5), []
    for i in range(n):
        own = [f"w{i}x{j}" for j in range(rng.choice((0, 2, 8, 60, 200)))]
        shared = [f"c{i % common}y{j}" for j in range(5)] if i % 11 else []
        more = out[rng.randrange(len(out))][1].split()[:40] if out and not i % 7 else []
        text = " ".join(own[:5] + shared + more + own[5:])
        out.append((i, text, "en", len(text)))
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reuse"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def sets(rows, share):
    each = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t, *_ in rows)}
    df = {}
    for s in each.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    stops = {g: n for g, n in df.items() if n > int(len(rows) * share)}
    return {i: s - set(stops) for i, s in each.items()}, stops


def test_candidates_against_all_pairs(spark, sf_dir):
    rows = corpus()
    own, size = sets(rows, reuse.P.stop_share)[0], {r[0]: r[3] for r in rows}
    want = {(d, s, len(own[d] & own[s]), len(own[d])) for d in own for s in own if d != s and size[s] >= 2 * size[d] and len(own[d] & own[s]) >= 0.1 * len(own[d]) > 0 and own[d] & own[s]}
    before = records(spark)
    got = reuse.found_candidates(spark, sf_dir).collect()
    assert {(r["digest_id"], r["source_id"], r["matching"], r["total"]) for r in got} == want and len(got) == len(want) > 20
    # every gram is a row once; no row of a pair comes of a common passage alone
    assert records(spark) - before < 1.5 * sum(map(len, own.values()))


@pytest.mark.parametrize("least", [0.1, 0.25, 1.0])
def test_pairs_meet_in_their_rarer_grams(spark, least):
    rng = random.Random(7)
    own = {i: {min(rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(rng.choice((1, 3, 10, 11, 30)))} for i in range(60)}
    size = {i: rng.choice((1, 2, 4, 5, 9)) for i in own}
    df = spark.createDataFrame([(i, size[i], len(s), g) for i, s in own.items() for g in s], "id long, size long, total long, gram long")
    want = {(d, s, len(own[d] & own[s])) for d in own for s in own if d != s and size[s] >= 2 * size[d] and size[d] <= 4 and len(own[d] & own[s]) / len(own[d]) >= least}
    got = candidates.in_longer(df, ["gram"], least, 2.0, 4).collect()
    assert sorted((r["digest_id"], r["source_id"], r["matching"]) for r in got) == sorted(want)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("share", [0.02, 0.05, 1.0])
def test_stop_grams_of_parts(spark, parts, share, monkeypatch):
    monkeypatch.setattr(grams, "COUNTED", 300)
    rows = [*corpus(), (None, None, None, None), (1000, "", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(parts)
    want = sets([r for r in rows if r[1] is not None], 0)[1]
    want = {g: n for g, n in want.items() if n > int(len(rows) * share)}
    assert {r["gram"]: r["df"] for r in grams.stops_of(docs, "text", 5, share).collect()} == want


def test_set_sizes_make_no_row_of_a_gram(spark, sf_dir):
    own = sets(corpus(), reuse.P.stop_share)[0]
    before = records(spark)
    assert {r["doc_id"]: r["n_grams"] for r in reuse.gram_set_sizes(spark, sf_dir).collect()} == {i: len(s) for i, s in own.items() if s}
    assert records(spark) - before < 8 * len(own)


def test_stop_grams_make_no_row_of_a_gram(spark, sf_dir):
    before = records(spark)
    assert {r["gram"]: r["df"] for r in reuse.stop_grams(spark, sf_dir).collect()} == sets(corpus(), reuse.P.stop_share)[1]
    assert records(spark) - before < 8 * len(corpus())


def test_grams_in_kernels_are_those_of_columns(spark):
    from loomtext.functions import text as tx

    texts = spark.createDataFrame([(1, "Eins, zwei_Drei! vier fünf sechs"), (2, None), (3, ""), (4, "a b c d"), (5, "a b c d e a b c d e a"), (6, "İ ß x́ ٣ Ⅷ 日本 z")], "id long, text string").repartition(2)
    want = texts.select("id", F.posexplode(tx.grams(tx.words(F.col("text")), 5)).alias("pos", "gram"))
    assert sorted(map(tuple, grams.places(texts, 5).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, grams.gram_table(texts, "id", "text", 5).collect())) == sorted(map(tuple, want.select("id", "gram").distinct().collect()))
    assert [tuple(r) for r in grams.places(texts, 5, {"b c d e a"}).orderBy("pos").collect()] == [(5, 1, "b c d e a"), (5, 6, "b c d e a")]


def test_many_grams_are_joined_with_the_same_result(spark, sf_dir, tmp_path, monkeypatch):
    from loomtext.operators import alignment

    texts = spark.createDataFrame([(i, t) for i, t, *_ in corpus()], "id long, text string")
    asked = texts.where("id % 40 = 3")
    found = lambda: sorted(map(tuple, alignment.seed_hits(asked, texts, 5).collect()))
    few = found()
    assert len(few) > 20
    monkeypatch.setattr(grams, "SENT", 3)
    assert grams.sent(grams.gram_table(asked, "id", "text", 5)) is None and found() == few
