import pytest
from conftest import WORDS, sentence

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_their_effects(spark, tmp_path):
    docs = [(i, sentence(i), "en", f"s{i % 3}", len(sentence(i))) for i in range(90)]
    docs += [(100 + i, " ".join(w.upper() + "!!" for w in WORDS[: 6 + i % 9]), "en", "s0", 9) for i in range(40)]
    docs += [(200 + i, sentence(i), "en", "s1", 9) for i in range(10)] + [(300, sentence(277, 43) + " write to me@site.org", "de", "s2", 9), (301, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(90), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert i == len(pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = now.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert not ids("quality") & set(range(100, 140)) and ids("quality") >= set(range(90))
    assert 300 in ids("quality")
    assert not ids("dedup") & set(range(200, 210)) and len(seen["dedup"]) == len(ids("dedup"))
    assert [r["text"] for r in seen["pii"] if r["doc_id"] == 300] == [sentence(277, 43) + " write to <email>"]
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(seen["mix"]) - 1.5 * words(seen["pii"])) <= 5
    assert all(r["lossless"] for r in seen["encode"]) and len(seen["encode"]) == len(seen["mix"])
    assert len(pipeline.run(spark, str(tmp_path)).collect()) == len(seen["encode"])


def test_every_stage_on_odd_and_empty_tables(spark, tmp_path, odd, empty):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES):
        for docs in (odd, empty):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert (i == len(pipeline.STAGES) - 1) == (out.columns != odd.columns), name
            assert docs is odd or rows == []
        assert stage(spark, odd, str(tmp_path)).count() == {"pii": odd.count(), "encode": odd.count()}.get(name, stage(spark, odd, str(tmp_path)).count())
    kept = {(r["doc_id"], r["text"]) for r in pipeline.dedup(spark, odd, str(tmp_path)).collect()}
    assert len(kept) == pipeline.dedup(spark, odd, str(tmp_path)).count() and (0, conftest_text(odd, 0)) in kept and not any(i == 2 for i, _ in kept)
    masked = pipeline.pii(spark, odd, str(tmp_path))
    assert masked.count() == odd.count()


def conftest_text(odd, i):
    return odd.where(f"doc_id = {i}").first()["text"]
