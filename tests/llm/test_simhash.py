import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import simhash_dedup as sh


def brute_fingerprint(text: bytes) -> int:
    w = text.lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_tables_are_perfect():
    high, patterns, count = sh.golay_tables()
    assert set(np.unique(count)) == {1, 6}
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    code, n = sh.near_codes(words)
    for w, c, k in zip(words, code, n):
        for index in c[:k]:
            base = int(index) << 11
            assert bin((base | sh._remainder(base)) ^ int(w)).count("1") <= 4


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
@settings(max_examples=300, deadline=None)
def test_fingerprints_within_four_bits_share_a_bucket(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    fp = np.array([a, b], np.uint64).view(np.int64)
    k, owner = sh.bucket_keys(fp)
    rows = sorted(zip((k >> 2).tolist(), (k & 3).tolist(), owner.tolist()))
    key = np.array([r[0] << 2 | r[1] for r in rows])
    x, y = sh.run_links(key >> 2, key & 3, fp[[r[2] for r in rows]])
    assert a == b or {(int(p), int(q)) for p, q in zip(x, y)} & {(int(fp[0]), int(fp[1])), (int(fp[1]), int(fp[0]))}


def test_long_runs_give_a_forest():
    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base] + [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)], np.uint64)).view(np.int64)
    a, b = sh.run_links(np.full(len(fps), 4 << 40), np.full(len(fps), 2), fps)
    assert len(a) == len(fps) - 1
    assert (np.bitwise_count((a ^ b).view(np.uint64)) <= 4).all()


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c d", "A b\x0bC d e f g", "é É Ä x y z"])
def test_fingerprint_equals_its_definition(text):
    assert sh.simhash(text.encode()) == brute_fingerprint(text.encode())


def brute_components(pairs):
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if bin(f ^ g).count("1") <= 4:
                root[find(f)] = find(g)
    best = {}
    for d, f in pairs:
        if d is not None:
            best[find(f)] = min(d, best.get(find(f), d))
    return {f: best.get(find(f)) for f in fps}


def test_odd_documents(odd):
    got = sh.near_duplicates(odd).collect()
    texts = [(r["doc_id"], brute_fingerprint((r["text"] or "").encode())) for r in odd.collect()]
    want = brute_components(texts)
    assert sorted((str(r["id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((str(d), f, want[f]) for d, f in texts)


def test_empty_table(empty):
    assert sh.near_duplicates(empty).collect() == []
    assert sh.deduplicated(empty).collect() == []


def test_one_of_each_group_stays(odd):
    got = sh.deduplicated(odd)
    assert got.columns == odd.columns
    ids = sorted((r["doc_id"], (r["text"] or "")[:10]) for r in got.collect())
    # 2 copies 0; 3, 4 and 5 have no word; the null id and the repeated row copy 1
    assert [i for i, _ in ids] == [0, 1, 1, 3, 6, 7, 8, 9, 10]


def test_split_buckets_lose_no_link(spark, monkeypatch):
    from loomtext.llm import common

    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    near = {base}
    for _ in range(300):
        f = int(rng.choice(sorted(near)))
        for _ in range(2):
            f ^= 1 << int(rng.integers(0, 64))
        near.add(f)
    far = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    pairs = [(i, f) for i, f in enumerate(sorted(near | far))]
    want = brute_components(pairs)
    monkeypatch.setattr(sh, "dealt", lambda r, c, i: common.dealt(r, c, i, most=5))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in pairs], "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] for r in sh.components(sh.fingerprint_links(df)).collect()}
    groups = {}
    for _, f in pairs:
        groups.setdefault(roots.get(f, f), set()).add(f)
    wanted = {}
    for _, f in pairs:
        wanted.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def jaccard(a, b):
    x, y = (set(sh.shingle_hashes(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_texts_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary, n)) for n in (30, 60, 120, 400, 3, 5)]
    texts = []
    for t in base:
        for k in range(25):
            w = t.split()
            for _ in range(k % 7):
                w[rng.integers(len(w))] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    texts += ["", " ", "A  b", "a b", *(" ".join(rng.choice(vocabulary, 80)) for _ in range(100))]
    got = {r["id"]: r["root"] for r in sh.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in range(20):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if root[i] == root[j]]
    assert all(got[i] != got[j] for i in range(len(texts)) for j in range(i) if root[i] != root[j])
    assert np.mean([got[i] == got[j] for i, j in linked]) > 0.97 and len(linked) > 300
    near = [(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= 0.9]
    assert np.mean([got[i] == got[j] for i, j in near]) > 0.99


def classes_of_all_pairs(texts):
    root = list(range(len(texts)))
    own = [set(sh.shingle_hashes(t.encode()).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) - 1e-9]
    while any(root[i] != root[j] for i, j in pairs):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return sorted(sorted(i for i in range(len(texts)) if root[i] == r) for r in set(root))


def found_classes(spark, texts):
    groups = {}
    for r in sh.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        groups.setdefault(r["root"], []).append(r["id"])
    return sorted(map(sorted, groups.values()))


def test_no_link_at_the_threshold_is_left_out(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(200):  # 40 of 50 shingles shared, or 80 of 100; and one word more changed, which is too much
        w, at = [f"a{x}" for x in rng.integers(0, 10**6, 49 + 45 * (i % 2))], [20, 60][: 1 + i % 2]
        texts += [" ".join(w), " ".join("other" if j in at else x for j, x in enumerate(w)), " ".join("third" if j in [*at, 30] else x for j, x in enumerate(w))]
    want = classes_of_all_pairs(texts)
    assert {len(c) for c in want} == {1, 2} and sum(len(c) == 2 for c in want) == 200
    assert found_classes(spark, texts) == want


@pytest.mark.parametrize("run", [2, 24])
def test_links_of_crowded_buckets_are_those_of_all_pairs(spark, monkeypatch, run):
    from loomtext.llm import common

    monkeypatch.setattr(sh, "SHORT_RUN", run)
    monkeypatch.setattr(sh, "dealt", lambda r, c, i: common.dealt(r, c, i, most=7))
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(300):  # copies with up to five words changed: about half of the pairs meet the threshold
        w = list(base)
        for i in rng.integers(0, 100, rng.integers(0, 6)):
            w[i] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w[: rng.integers(70, 101)]))
    assert found_classes(spark, texts) == classes_of_all_pairs(texts)


def test_crossing_pairs_and_bounds_lose_no_pair():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, n), rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]) for n in [*rng.integers(1, 300, 60), *range(60, 90)]]
    sets += [np.unique(np.r_[s[rng.random(len(s)) > 0.08], np.uint64(i)]) for i, s in enumerate(sets)]
    listed = np.sort(rng.choice(base, 50, replace=False))
    rows = []
    for i, x in enumerate(sets):
        keys, first, size, odd = sh.rarest(x, listed, np.arange(50) % 7 + 2)
        place = np.concatenate([np.arange(n) for n in first])
        rows += sorted((int(k), i, i, int(n) << 32 | int(at), int(o)) for k, n, at, o in zip(keys, np.repeat(size, first), place, np.repeat(odd, first)))
    rows.sort()
    got = {(int(x), int(y)) for a, b in sh.crossing_pairs(*np.array(rows, np.int64).T, most=50) for x, y in zip(a, b)}
    shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
    want = {(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9}
    assert len(want) > 40 and want <= got
    for (i, j), n in shared.items():
        differ = sum(bin(x ^ y).count("1") for x, y in zip(sh.parities(sets[i]), sh.parities(sets[j])))
        assert differ <= len(sets[i]) + len(sets[j]) - 2 * n
    assert list(sh.crossing_pairs(*(np.array(x) for x in ([1, 1], [5, 6], [5, 5], [9 << 32] * 2, [0, 0])))) == []


def test_rows_grow_with_the_texts_of_a_group_not_its_pairs(spark, monkeypatch):
    """Pairs just below the similarity are all tested, but in kernels: no table holds one row for each of them."""
    rows, real, n = [], sh.written, 60

    def counted(df, name):
        out = real(df, name)
        rows.append((out.count(), name))
        return out

    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(n):  # some 0.75 alike, which sizes and parities of such long texts cannot tell from 0.8
        w = list(base)
        for i in rng.choice(400, 29, replace=False):
            w[5 * i] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts[:5]]
    want = classes_of_all_pairs(texts)
    assert len(want) == n
    empty = np.empty(0, np.int64)
    monkeypatch.setattr(sh, "close_pairs", lambda *_: (empty, empty))  # all is left to the exact pass
    monkeypatch.setattr(sh, "written", counted)
    assert found_classes(spark, texts) == want
    assert max(rows)[0] <= 4 * n


@pytest.mark.parametrize("most", [20_000, 7])
def test_sets_that_meet_are_linked_as_by_all_pairs(spark, monkeypatch, most):
    from loomtext.llm import common

    monkeypatch.setattr(sh, "dealt", lambda r, c, i: common.dealt(r, c, i, most=most))
    monkeypatch.setattr(sh, "TESTED", 3)
    empty = np.empty(0, np.int64)
    monkeypatch.setattr(sh, "close_pairs", lambda *_: (empty, empty))
    rng = np.random.default_rng(18)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60 + 150 * g)]
        for _ in range(30):
            w = list(base)
            for i in rng.integers(0, len(w), rng.integers(0, 3 + 3 * g)):
                w[i] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(w))
    assert found_classes(spark, texts) == classes_of_all_pairs(texts)


def test_forest_connects_what_the_pairs_connect():
    rng = np.random.default_rng(19)
    for n in (1, 2, 30, 300):
        a, b = rng.integers(-(2**62), 2**62, 100)[rng.integers(0, 100, (2, n))]
        x, y = sh.forest(a, b)
        pairs, kept = set(zip(a.tolist(), b.tolist())), list(zip(x.tolist(), y.tolist()))
        assert set(kept) <= pairs

        def classes(links):
            root = {v: v for v in np.r_[a, b].tolist()}
            for _ in root:
                for p, q in links:
                    root[p] = root[q] = min(root[p], root[q])
            return root

        assert classes(kept) == classes(pairs)
        assert len(kept) == len(classes(pairs)) - len(set(classes(pairs).values()))


def test_a_large_group_of_similar_texts_is_one(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHORT_RUN", 5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(120)] + [" ".join(reversed(words))]
    got = sh.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["root"] for r in got if r["id"] < 120}) == 1 and len({r["root"] for r in got}) == 2


def test_query_against_loops(spark, tmp_path):
    from conftest import sentence

    texts = [sentence(i) for i in range(12)] + [sentence(3), sentence(4, 400), sentence(4, 401), sentence(4, 402), "Case CASE case", "case case CASE", None, "", " \t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = {i: brute_fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    lowest = dict(zip(fps, fps))
    for _ in texts:
        for i in fps:
            lowest[i] = min(lowest[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 4)
    got = sh.op1_simhash(spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(i, f"{fps[i]:016x}", lowest[i]) for i in fps]
