import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.llm import syncmers as sy


def ordered(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))


def test_odd_documents(odd):
    rows = ordered(odd.collect())
    want = []
    for i, r in enumerate(rows):
        t, nxt = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        h = len(t) // 2
        want.append((str(r["doc_id"]), len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    got = [(str(r["id"]), len(r["text"]), hashlib.sha256(r["edited"].encode()).hexdigest()) for r in sy.edited_pairs(odd).collect()]
    assert sorted(got) == sorted(want)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sy, "RANGE_ROWS", 3)
    df = spark.createDataFrame([(i * i % 1009, f"text {i} of many words") for i in range(200)], "doc_id long, text string").repartition(5)
    rows = ordered(df.collect())
    want = sorted((r["doc_id"], (r["text"][: len(r["text"]) - len(r["text"]) // 2] + rows[(i + 1) % len(rows)]["text"][: len(r["text"]) // 2])) for i, r in enumerate(rows))
    assert sorted((r["id"], r["edited"]) for r in sy.edited_pairs(df).collect()) == want


def test_anchors_are_closed_syncmers_and_context_free(spark):
    words = [f"w{i * i % 31}x{i % 7}" for i in range(60)]
    texts = [" ".join(words), "other words first " + " ".join(words), "  ".join(words[:40]), "few words", "", " \n"]
    df = sy.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "a")
    got = [[(x["at"], x["hash"]) for x in r["a"]] for r in df.orderBy("i").collect()]
    hashes = [{h for _, h in g} for g in got]
    assert hashes[0] - hashes[1] == set() and hashes[2] <= hashes[0]
    assert all((at + 3, h) in got[1] for at, h in got[0])
    assert len(got[3]) == 2 and got[4] == got[5] == []
    pairs = spark.createDataFrame([(words,)], "w array<string>").selectExpr("transform(w, x -> xxhash64(x)) as h").selectExpr("transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])) as p").first()["p"]
    closed = [i for i in range(len(words) - sy.K + 1) if min(pairs[i : i + sy.INNER]) in (pairs[i], pairs[i + sy.INNER - 1])]
    assert [at for at, _ in got[0]] == closed


def test_short_texts_have_anchors_of_their_own(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(9 + i % 9)) for i in range(180)]
    df = sy.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "a")
    df = sy.with_likeness(df.withColumn("b", F.lag("a").over(Window.orderBy("i"))), "a", "b", "near")
    got = df.select("i", sy.fingerprint("a").alias("f"), "near").collect()
    assert all(r["f"] for r in got) and len({r["f"] for r in got}) == len(texts)
    assert {r["near"] for r in got if r["near"] is not None} == {0.0}
    pair = spark.createDataFrame([(" ".join(texts[3].split()[:6]), texts[3])], "x string, y string")
    assert sy.with_likeness(sy.with_anchors(sy.with_anchors(pair, "x", "a"), "y", "b"), "a", "b", "near").first()["near"] > 0.5


def brute_likeness(a, b):
    x, y = list(dict.fromkeys(h for _, h in a)), list(dict.fromkeys(h for _, h in b))
    if not x and not y:
        return 1.0
    p, q = [h for h in x if h in y], [h for h in y if h in x]
    follow = set(zip(q, q[1:]))
    return 2 * (bool(p) + sum(s in follow for s in zip(p, p[1:]))) / (len(x) + len(y))


def test_likeness_and_matches_against_loops(spark):
    base = [f"w{i % 37}v{i % 11}" for i in range(80)]
    texts = [" ".join(base[:n]) for n in range(31)] + [" ".join(base), " ".join(base[40:] + base[:40]), " ".join(base[:30] + ["new"] + base[30:]), " ".join(base * 2), "x y z", ""]
    df = sy.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "a")
    pairs = df.join(df.select(F.col("i").alias("j"), F.col("a").alias("b")), F.expr("(i * 7 + j * 3) % 4 = 0"))
    pairs = sy.with_matches(sy.with_likeness(pairs, "a", "b", "near"), "a", "b", "met")
    for r in pairs.collect():
        assert abs(r["near"] - brute_likeness(r["a"], r["b"])) < 1e-12
        first = [{h: at for at, h in reversed(side)} for side in (r["a"], r["b"])]
        assert [tuple(m) for m in r["met"]] == sorted((first[0][h], first[1][h]) for h in first[0] if h in first[1])
    moved = pairs.where("i = 31 and j in (31, 32, 33)").select("j", "near").collect()
    assert all(r["near"] == 1.0 if r["j"] == 31 else 0.5 < r["near"] < 1.0 for r in moved)


def test_null_ids_alone_follow_each_other(spark):
    got = sy.edited_pairs(spark.createDataFrame([(None, "aaaa"), (None, "bbbb")], "doc_id long, text string")).collect()
    assert sorted(r["edited"] for r in got) == ["aabb", "bbaa"]


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in sy.op5_syncmers(spark, str(tmp_path)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != "" and got[1]["near_next"] == 1.0
    assert got[3]["n_chars"] == 0 and got[3]["fingerprint"] == "" and 0 <= got[2]["near_next"] <= 1


def test_empty_table(empty):
    assert sy.edited_pairs(empty).collect() == []
