import math

import numpy as np

from loomtext.llm import embedding_dedup as ed


def brute(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(rows[i][1]), np.float64(rows[j][1])
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links[i].add(j)
    out = []
    for i, (vid, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((str(vid), len(links[i]), min(known) if known else None))
    return sorted(out, key=str)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        rows += [(len(rows) + k, (base + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(1 + c % 5)]
    big = rng.standard_normal(16)
    rows += [(1000 + k, (big + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [1.0, 2.0])]
    rows += [rows[0], (None, rows[3][1]), (3000, rows[3][1]), (3001, (2 * np.float32(rows[3][1])).tolist())]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, id long, copies long").repartition(3)
    got = sorted(((str(r["id"]), r["n_links"], r["component_id"]) for r in ed.link_vectors(df).collect()), key=str)
    assert got == brute(rows)


def test_oracle_agrees(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        rows += [(len(rows) + k, (base + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(1 + c % 5)]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, rows[3][1]), (104, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(map(tuple, con.execute(ed.ORACLE).fetchall()))
    assert sorted(tuple(r) for r in ed.op8_embedding_dedup(spark, str(tmp_path)).collect()) == want


def test_empty_table(spark):
    assert ed.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_split_buckets_count_each_pair_once(spark, monkeypatch):
    from loomtext.llm import common

    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(50)]
    monkeypatch.setattr(ed, "dealt", lambda r, c, i: common.dealt(r, c, i, most=7))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((str(r["id"]), r["n_links"], r["component_id"]) for r in ed.link_vectors(df).collect()), key=str)
    assert got == brute(rows)


def test_only_rows_with_a_partner_stay_in_a_bucket():
    rng = np.random.default_rng(9)
    code = rng.integers(0, 1 << 14, (90, 24)).astype(np.uint16)
    for i in range(0, 90, 3):
        code[i + 1] = code[i] ^ np.uint16(1 << 3)  # one bit of each table
        code[i + 1, 5] = code[i, 5]
    most = ed.most_bits()
    for size in (10, 90):  # short runs and one long one
        for t in (4, 5, 6):
            code[:, t] = 7
            run = (np.int64(t) << 14 << 20) + np.arange(90) // size
            found = ed.partnered(run, np.full(90, -1), code, 14, most)
            want = np.zeros(90, bool)
            for i in range(90):
                for j in range(90):
                    bits = sum(bin(int(a ^ b)).count("1") for a, b in zip(code[i], code[j]))
                    first = [int(a) == int(b) for a, b in zip(code[i], code[j])].index(True)
                    want[i] |= i != j and i // size == j // size and bits <= most and first == t
            assert found.tolist() == want.tolist()


def test_links_keep_far_below_the_bound_of_bits():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((400, 32))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * other
    apart = np.bitwise_count(ed.codes(x) ^ ed.codes(y)).sum(1)
    assert apart.max() <= ed.most_bits() - 10
