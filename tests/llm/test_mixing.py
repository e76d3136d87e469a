from collections import defaultdict

from loomtext.llm import mixing


def n_words(text):
    return len((text or "").encode().split())


def test_odd_documents(odd):
    got = mixing.mix(odd).collect()
    assert sorted((str(r["id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), n_words(r["text"])) for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    # plain water-filling
    capped, target = set(), {}
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 2.0 * sizes[s] if s in capped else rest * weights[s] / sum(weights[x] for x in open_) for s in names}
        new = {s for s in open_ if target[s] >= 2 * sizes[s]}
        if not new:
            break
        capped |= new
    for s in names:
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 1


def test_a_source_without_words_gives_its_weight_away(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(30)] + [(99, "", "s9")], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    assert got == {"s0": 200.0, "s1": 250 / 3, "s2": 500 / 3, "s9": 0.0}


def test_reruns_agree(odd):
    key = lambda r: (str(r["id"]), r["size"], r["taken"])
    assert sorted(map(key, mixing.mix(odd).collect())) == sorted(map(key, mixing.mix(odd.repartition(7)).collect()))


def test_mixed_documents_have_the_words_taken(odd):
    taken = sum(r["taken"] for r in mixing.mix(odd).collect())
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    assert sum(n_words(r["text"]) for r in got.collect()) == taken


def test_empty_and_wordless_tables(spark, empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed(empty).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(wordless).collect()] == [(0, 0.0)] * 2


def test_query_against_its_sql(spark, tmp_path):
    import duckdb
    from conftest import sentence

    rows = [(i, sentence(i, 3 + i % 40) if i % 7 else None, f"s{i % 5}" if i % 11 else None) for i in range(120)] + [(500, "", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = mixing.op6_mixing(spark, str(tmp_path))
    rounded = lambda df: sorted(tuple(round(float(v), 6) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert rounded(got.toPandas()) == rounded(con.sql(mixing.ORACLE).df())
