"""Language-model scores from a probabilistic suffix tree.

Texts are lower-cased words separated by one space and closed by an end symbol; the tree's symbols are their UTF-8
bytes. A context of up to ``depth`` symbols is a state if it occurs at least ``least`` times ``n ** (2 / 3)`` times among
``n`` training positions, and its next-symbol distribution diverges from that of the next shorter context by more than
a likelihood-ratio bound. So the tree grows with the corpus, as the cube root of its size at most (``DEPTH / least`` times
that): more text adds rarer contexts, while what every task holds grows far more slowly than the text. Distributions are
smoothed with the shorter context's. Each symbol is scored in the longest suffix of its history that is a state. The
states, closed under prefixes, form an automaton, so that a text is scored by array look-ups on many stretches at once.

All counts are taken over all training texts by shuffled aggregation: windows of symbols for the tree and hashed words
for the unigram base. Only words frequent enough to be few (a share of ``FREQUENT`` or more) are sent to the tasks; the
rest are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, table, text_bytes, written

#: Symbols of the longest context; a window of seven bytes is counted as one number.
DEPTH = 6
#: Occurrences that a context needs, over the number of training positions to the power of 2/3.
LEAST = 0.003
#: Likelihood-ratio bound of a state: nats for itself and for each distinct next symbol.
DIVERGENCE = (5.0, 2.0)
ROOT_PRIOR = 0.1
BASE_PRIOR = 0.1
#: Words with at least this share of the training tokens are known to every task: at most 1 / FREQUENT of them.
FREQUENT = 2e-6
SEED = 42
END, GAP = b"\n", b" "
#: Symbols that one pass of the scoring automaton takes in a row.
STRETCH = 512
#: Distinct counts that a task gathers before it merges or hands them on.
GATHER = 3_000_000
WORDS_HELD = 300_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED) - (1 << 63)


def stream(words: list[bytes]) -> bytes:
    """A text's symbols after ``DEPTH`` end symbols, which stand for what comes before it."""
    return END * DEPTH + GAP.join(words) + END


def windows(streams: list[bytes]) -> np.ndarray:
    """Every scored symbol with its ``DEPTH`` predecessors, as one number: the symbol lowest, its neighbours above it."""
    s = np.frombuffer(b"".join(streams), np.uint8)
    at = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(7 - DEPTH, np.uint8), s], 8)
    keep = scored(streams)[DEPTH:]
    packed = np.ascontiguousarray(at[keep]).view(">u8").ravel().astype(np.int64)
    return packed & ((1 << 8 * (DEPTH + 1)) - 1)


def scored(streams: list[bytes]) -> np.ndarray:
    """Which symbols of the joined streams are scored: all but the leading end symbols."""
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    keep = np.ones(sizes.sum(), bool)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    for k in range(DEPTH):
        keep[first + k] = False
    return keep


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[start], np.add.reduceat(c, start)


def count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 a hashed word, 1 a window, 2 the number of texts."""
    words: Counter[bytes] = Counter()
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    texts, held = 0, 0

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 100_000):
            k, c = key[at : at + 100_000], n[at : at + 100_000]
            yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], ["kind", "key", "n"])

    def word_rows() -> Iterator[pa.RecordBatch]:
        yield from rows(0, np.fromiter(map(word_hash, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
        words.clear()

    for batch in batches:
        for part in slices(batch):
            split = [t.lower().split() for t in text_bytes(part.column("text"))]
            texts += len(split)
            for w in split:
                words.update(w)
            if len(words) > WORDS_HELD:
                yield from word_rows()
            k, c = np.unique(windows([stream(w) for w in split]), return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > GATHER:
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > GATHER // 2:
                    yield from rows(1, k, c)
                    keys, counts, held = [], [], 0
    yield from word_rows()
    if keys:
        yield from rows(1, *_merge(keys, counts))
    if texts:
        yield from rows(2, np.zeros(1, np.int64), np.array([texts]))


@dataclass
class Tree:
    """The automaton: for each state and symbol class, log10 probability and next state (both flat)."""

    classes: np.ndarray
    width: int
    logs: np.ndarray
    moves: np.ndarray

    def log_probabilities(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each symbol of the joined streams, given up to ``DEPTH`` before it."""
        s = self.classes[np.frombuffer(b"".join(streams), np.uint8)]
        n = len(s)
        rows = -(-n // STRETCH)
        padded = np.zeros(DEPTH + rows * STRETCH, s.dtype)
        padded[:DEPTH] = self.classes[END[0]]
        padded[DEPTH : DEPTH + n] = s
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, DEPTH + STRETCH)[::STRETCH].T)
        out = np.empty((STRETCH, rows), np.float32)
        state = np.zeros(rows, np.int32)
        for i, symbols in enumerate(columns):
            at = state * self.width + symbols
            if i >= DEPTH:
                out[i - DEPTH] = self.logs[at]
            state = self.moves[at]
        return out.T.ravel()[:n]

    def scores(self, streams: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        p = np.where(scored(streams), self.log_probabilities(streams), 0).astype(np.float64)
        return np.add.reduceat(p, np.r_[0, np.cumsum(sizes)[:-1]])


def build_tree(levels: list[list[tuple[int, np.ndarray, np.ndarray]]]) -> Tree:
    """``levels[d]``: (context, next symbols, counts) of the frequent contexts of d symbols, nearest symbol lowest."""
    total = np.full(256, ROOT_PRIOR)
    for _, symbol, n in levels[0]:
        total[symbol] += n
    used = np.flatnonzero(total > ROOT_PRIOR)
    classes = np.full(256, len(used), np.int32)  # one class for all bytes that training never had
    classes[used] = np.arange(len(used))
    width = len(used) + 1
    total /= total.sum()
    root = np.r_[total[used], total[classes == len(used)][:1] if len(used) < 256 else 1.0]
    names: dict[tuple[int, int], int] = {(0, 0): 0}
    probability, parents, own = [root], [0], [(0, 0)]
    for d in range(1, len(levels)):
        for context, symbol, n in sorted(levels[d], key=lambda x: x[0]):
            key = (d, context)
            if d > 1 and (d - 1, context >> 8) not in names:
                continue  # the prefix leads to it
            parent = names.get((d - 1, context & ((1 << 8 * (d - 1)) - 1)))
            if parent is None:
                continue
            base = probability[parent]
            c = classes[symbol]
            count = n.sum()
            divergence = float((n * np.log(n / count / base[c])).sum())
            if divergence > DIVERGENCE[0] + DIVERGENCE[1] * len(n):
                p = base * len(n)
                p[c] += n
                p /= count + len(n)
            else:
                p = base  # no state of its own: scored as its suffix, kept only as a step to longer ones
            names[key] = len(probability)
            probability.append(p if p is base else p.astype(np.float32))
            parents.append(parent)
            own.append(key)
    moves = np.zeros((len(own), width), np.int32)
    children: dict[int, list[tuple[int, int]]] = {}
    for (d, context), i in names.items():
        if d:
            children.setdefault(names[d - 1, context >> 8], []).append((int(classes[context & 255]), i))
    for i in range(len(own)):
        if i:
            moves[i] = moves[parents[i]]
        for c, child in children.get(i, ()):
            moves[i, c] = child
    return Tree(classes, width, np.log10(np.stack(probability)).astype(np.float32).ravel(), moves.ravel())


def contexts(grams: DataFrame, symbols: int, least: float = LEAST) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The frequent contexts of each length with their next symbols; a context has at most 256 of them."""
    levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
    rows = grams.select("key", "n")
    for d in range(DEPTH, -1, -1):
        lists = rows.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("key").bitwiseAND(255).cast("int").alias("s"), "n")).alias("next"))
        got = lists.where(F.col("total") >= least * symbols ** (2 / 3)).select("context", F.expr("transform(next, x -> x.s)").alias("s"), F.expr("transform(next, x -> x.n)").alias("n")).toArrow().combine_chunks()
        ends, flat = [np.empty(0, np.int64)] * 2, [np.empty(0, np.int64)] * 2
        for k, c in enumerate(("s", "n") if got.num_rows else ()):  # one array for all contexts of a length
            lists = got.column(c).chunk(0)
            ends[k], flat[k] = lists.offsets.to_numpy(), lists.values.to_numpy()
        levels.append([(c, flat[0][ends[0][i] : ends[0][i + 1]], flat[1][ends[1][i] : ends[1][i + 1]]) for i, c in enumerate(got.column("context").to_pylist())])
        del got
        if d:
            rows = rows.groupBy(F.col("key").bitwiseAND((1 << 8 * d) - 1).alias("key")).agg(F.sum("n").alias("n"))
            if d >= DEPTH - 1:
                rows = written(rows, "grams")
    for level in levels:
        for i, (c, s, n) in enumerate(level):
            order = np.argsort(s)
            level[i] = (c, s[order], n[order])
    return levels[::-1]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, least: float = LEAST) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` chooses what is learnt.

    Null and empty texts are one end token; a null id is never learnt from; repeated rows are scored alike; with nothing
    to learn from all counts are 0; very long texts are scored whole; an empty table gives no rows; other columns are
    ignored. ``least``: see the module.
    """
    chosen = F.coalesce(train if train is not None else F.lit(True), F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("id"), chosen.alias("trained"), F.col(text_col).alias("text"))
    counted = own.where("trained").select("text").mapInArrow(count_kernel, "kind int, key long, n long")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = {r["kind"]: (r["n"], r["rows"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    (n_words, n_distinct), texts, symbols = sums.get(0, (0, 0)), sums.get(2, (0, 0))[0], sums.get(1, (0, 0))[0]
    tokens, types = n_words + texts, n_distinct + bool(texts)
    words = counts.where("kind = 0").select("key", "n")
    top = words.where(F.col("n") >= max(1.0, FREQUENT * tokens)).toArrow()
    known = dict(zip(top["key"].to_pylist(), (log10(n + BASE_PRIOR) for n in top["n"].to_pylist())))
    tree = build_tree(contexts(counts.where("kind = 1"), symbols, least))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(((tree.classes, tree.width, tree.logs, tree.moves), known))  # plain arrays
    end_log, norm = log10(texts + BASE_PRIOR), log10(tokens + BASE_PRIOR * (types + 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known = shared.value
        tree = Tree(*parts)
        row = TaskContext.get().partitionId() << 40
        memo: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            for part in slices(batch):
                split = [t.lower().split() for t in text_bytes(part.column("text"))]
                n, found, base, rare, times, sizes = [], [], [], [], [], [0]
                for w in split:
                    total, seen = end_log, int(texts > 0)
                    for word, c in Counter(w).items():
                        value = memo.get(word)
                        if value is None:
                            h = word_hash(word)
                            value = memo[word] = (known.get(h, 0.0), h if h not in known else 0)
                        if value[1]:
                            rare.append(value[1])
                            times.append(c)
                        else:
                            total += c * value[0]
                            seen += c
                    if len(memo) > WORDS_HELD:
                        memo.clear()
                    n.append(len(w) + 1)
                    found.append(seen)
                    base.append(total)
                    sizes.append(len(rare))
                scores = tree.scores([stream(w) for w in split])
                at = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (rare, times)]
                numbers = pa.array(np.arange(row, row + len(split)))
                row += len(split)
                yield pa.record_batch([numbers, part.column("id"), part.column("trained"), pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), *lists], ["row", "id", "trained", "n_tokens", "seen", "base", "score", "rare", "times"])

    done = written(own.mapInArrow(kernel, "row long, id long, trained boolean, n_tokens long, seen long, base double, score double, rare array<long>, times array<long>"), "scored")
    loose = done.select("row", F.inline(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("c"))))
    looked = loose.join(words.where(F.col("n") < max(1.0, FREQUENT * tokens)), "key", "left")
    extra = looked.groupBy("row").agg(
        F.sum(F.col("c") * F.log10(F.coalesce("n", F.lit(0)) + BASE_PRIOR)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("more")
    )
    return done.drop("rare", "times").join(extra, "row", "left").select(
        "id", "trained", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 10) == 0
    out = score_texts(table(spark, sf_dir, "documents"), train=~held)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
