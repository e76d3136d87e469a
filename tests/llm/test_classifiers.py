import zlib

import numpy as np
from conftest import WORDS, sentence

from loomtext.llm import language_id as li
from loomtext.llm import quality_gam as qg


def test_gam_learns_main_effects_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5))).astype(float)
    model = qg.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    assert (1, 2) in [tuple(sorted(p)) for p in model.pairs]


def test_scores_are_sums_of_table_look_ups():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    model = qg.fit(x, (x[:, 0] > 0.5).astype(float))
    one = x[7]
    total = model.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, one))
    place = [np.searchsorted(e, v, "right") for e, v in zip(model.pair_edges, one)]
    total += sum(g[place[i], place[j]] for (i, j), g in zip(model.pairs, model.grids))
    assert abs(model.score(x)[7] - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_of_odd_texts():
    for t in (b"", b" \n\t", b"x", "日本語".encode(), b"|" * 1000, b"a " * 100_000):
        f = qg.features(t)
        assert len(f) == len(qg.FEATURES) and np.isfinite(f).all()


def _quality_tables(spark):
    docs = [(i, sentence(i) if i % 3 else " ".join(w.upper() + "!!" for w in WORDS[: 5 + i % 9])) for i in range(400)] + [(1000, None), (1001, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(1000, 1, 0), (None, 1, 0), (5000, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_query(spark, tmp_path):
    docs, labels = _quality_tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in qg.op4_quality(spark, str(tmp_path)).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in range(300, 400)]) > 0.95


def test_quality_of_odd_documents_and_empty_tables(odd, empty, spark):
    _, labels = _quality_tables(spark)
    model = qg.train(odd, labels)
    assert sorted(str(r["id"]) for r in qg.scored(odd, model).collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    none = qg.train(empty, labels.limit(0))
    assert qg.scored(empty, none).collect() == [] and qg.accepted(empty, none).collect() == []
    assert qg.accepted(odd, none).columns == odd.columns


def _language_rows():
    kinds = {"en": "the of and with that", "de": "der und nicht sich mit", "fr": "les des que pour dans", "es": "los del una por para"}
    out = []
    for i in range(240):
        lang = list(kinds)[i % 4]
        w = kinds[lang].split()
        out.append((i, " ".join(w[(i * 3 + j * (j + i)) % 5] for j in range(6 + i % 30)), lang))
    return out


def test_language_query(spark, tmp_path):
    rows = _language_rows() + [(1000, None, "en"), (1001, "", None), (1002, "123 --- 456", "de"), (1003, "the of and", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in li.op10_language(spark, str(tmp_path)).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "en"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i in got)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in _language_rows() if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_families_come_first_and_unknown_languages_stand_alone():
    assert li.family("de") == li.family("en") != li.family("fr") and li.family("xx") != li.family("yy")


def test_languages_of_odd_documents_and_empty_tables(odd, empty):
    got = li.identify(odd, li.train(odd)).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] in ("en", "de", "fr", "und") for r in got)
    assert li.identify(empty, li.train(empty)).collect() == []
    assert {r["lang_pred"] for r in li.identify(odd, li.train(empty)).collect()} == {"und"}


def test_one_language_alone(spark):
    df = spark.createDataFrame([(i, "some words of it", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify(df, li.train(df)).collect()} == {"en"}
