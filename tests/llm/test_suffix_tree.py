import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import sentence
from pyspark.sql import functions as F

from loomtext.llm import suffix_tree_lm as lm


def brute_counts(texts):
    """Next-symbol counts of every context by plain loops."""
    counts = [defaultdict(Counter) for _ in range(lm.DEPTH + 1)]
    for t in texts:
        s = lm.stream(t.lower().split())
        for i in range(lm.DEPTH, len(s)):
            for d in range(lm.DEPTH + 1):
                counts[d][int.from_bytes(s[i - d : i], "big")][s[i]] += 1
    return counts


def brute_score(tree_levels, text):
    """Longest suffix that is a state, distributions smoothed down the chain, one symbol after the other."""
    n = sum(sum(c.values()) for c in tree_levels[0].values())
    root = np.full(256, lm.ROOT_PRIOR)
    for x, c in tree_levels[0][0].items():
        root[x] += c
    root /= root.sum()
    states = {(0, 0): root}
    for d in range(1, lm.DEPTH + 1):
        for context, following in tree_levels[d].items():
            total = sum(following.values())
            parent = states.get((d - 1, context & ((1 << 8 * (d - 1)) - 1)))
            if total < lm.LEAST * n ** (2 / 3) or parent is None or (d > 1 and (d - 1, context >> 8) not in states):
                continue
            kl = sum(c * math.log(c / total / parent[x]) for x, c in following.items())
            p = parent
            if kl > lm.DIVERGENCE[0] + lm.DIVERGENCE[1] * len(following):
                p = parent * len(following)
                for x, c in following.items():
                    p[x] += c
                p = p / (total + len(following))
            states[d, context] = p
    s, out = lm.stream(text.lower().split()), 0.0
    for i in range(lm.DEPTH, len(s)):
        for d in range(lm.DEPTH, -1, -1):
            p = states.get((d, int.from_bytes(s[i - d : i], "big")))
            if p is not None:
                out += math.log10(p[s[i]])
                break
    return out


def test_odd_documents_against_loops(odd, monkeypatch):
    rows = odd.collect()
    got = lm.score_texts(odd, train=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    trained = [(r["text"] or "").encode() for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10]
    words = Counter(w for t in trained for w in t.lower().split())
    n, v = sum(words.values()) + len(trained), len(words) + 1
    levels = brute_counts(trained)
    want = []
    for r in rows:
        t = (r["text"] or "").encode()
        c = [words[w] for w in t.lower().split()] + [len(trained)]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        want.append((str(r["doc_id"]), len(c), sum(x > 0 for x in c), n, round(base, 4), brute_score(levels, t)))
    key = lambda x: x[:5]
    have = sorted(((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), r["score"]) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-5 * abs(b[5]) + 1e-6


def test_long_texts_are_scored_as_one():
    """Stretches overlap by the tree's depth, so where they are cut doesn't matter."""
    levels = brute_counts([sentence(i).encode() for i in range(50)])
    tree = lm.build_tree([[(c, np.array(sorted(f)), np.array([f[x] for x in sorted(f)])) for c, f in level.items()] for level in levels])
    texts = [sentence(3, 2000).encode(), b"", b"x", sentence(4, 700).encode()]
    streams = [lm.stream(t.lower().split()) for t in texts]
    together = tree.scores(streams)
    assert np.allclose(together, [tree.scores([s])[0] for s in streams], atol=1e-3)


def test_nothing_to_learn_from(odd, empty):
    got = lm.score_texts(odd, train=F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert lm.score_texts(empty).collect() == []


def test_query_columns_against_loops(spark, tmp_path):
    texts = [sentence(i, 5 + i) for i in range(40)] + ["", None, "Beta BETA beta", "unseen words here"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    split = [(t or "").encode().lower().split() + [None] for t in texts]  # None: the end
    counts = Counter(w for i, words in enumerate(split) if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = lm.op7_suffix_tree(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, words in enumerate(split):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6
        assert r["score"] < 0
