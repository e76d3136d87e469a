"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few bounded statistics. Each statistic is cut into quantile bins; boosting visits the statistics in
turn and adds a small step of a shallow tree over one statistic's bins to its lookup table, then does the same over
grids of the most promising pairs. Only tables remain: a score is the logistic of a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hashed_share, table, text_bytes, written

#: Bound of the labelled rows that a model is fitted on: those with the smallest hashed ids.
FIT_ROWS = 20_000
CUT = 0.3
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 60
RATE = 0.1
LEAST_ROWS = 5
FEATURES = (
    "log_words", "word_length", "upper", "symbols", "digits", "exclamations", "pipes", "stops", "commas", "distinct",
    "repeated_lines", "short_words", "long_words", "line_words", "marked_words", "caps_words", "commonest",
)
_CLASS = np.zeros(256, np.int8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 1
_SYMBOL = _CLASS == 0
_SYMBOL[[ord(c) for c in ".,;:'\"()-!?|"]] = False


def features(text: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of ``FEATURES``; all are 0 for an empty text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, bytes_, 5)
    letters = max(1.0, kinds[1] + kinds[2])
    solid = max(1.0, len(text) - kinds[4])
    at = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(1 for w in counts if w[-1:] in b"#$%&*!@~^+=<>" for _ in range(counts[w]))
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(n), at.mean(), kinds[2] / letters, bytes_[_SYMBOL].sum() / solid, kinds[3] / solid, bytes_[33] / n, bytes_[124] / n,
        bytes_[46] / n, bytes_[44] / n, len(counts) / n, 1 - len(set(lines)) / max(1, len(lines)), (at <= 3).mean(), (at >= 12).mean(),
        np.log1p(n / max(1, len(lines))), marked / n, caps / n, max(counts.values()) / n,
    ]


def step_tree(gain: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: splits the bin sums until ``leaves`` and gives each leaf its Newton step."""
    cuts = [(0, len(gain))]
    g, w = np.r_[0.0, np.cumsum(gain)], np.r_[0.0, np.cumsum(weight)]

    def best(lo: int, hi: int) -> tuple[float, int]:
        k = np.arange(lo + 1, hi)
        if not len(k):
            return 0.0, lo
        left, right = (g[k] - g[lo], w[k] - w[lo]), (g[hi] - g[k], w[hi] - w[k])
        score = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - (g[hi] - g[lo]) ** 2 / (w[hi] - w[lo] + 1)
        score[(left[1] < LEAST_ROWS / 4) | (right[1] < LEAST_ROWS / 4)] = 0
        i = int(score.argmax())
        return float(score[i]), int(k[i])

    while len(cuts) < leaves:
        found = [(*best(lo, hi), i) for i, (lo, hi) in enumerate(cuts)]
        score, at, i = max(found)
        if score <= 1e-9:
            break
        lo, hi = cuts[i]
        cuts[i : i + 1] = [(lo, at), (at, hi)]
    out = np.zeros(len(gain))
    for lo, hi in cuts:
        out[lo:hi] = (g[hi] - g[lo]) / (w[hi] - w[lo] + 1)
    return out


@dataclass
class Gam:
    """Bin edges and lookup tables; pairs use every fourth edge or so."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, p = self.bins(x, self.edges), self.bins(x, self.pair_edges)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.grids):
            out += t[p[:, i], p[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the logistic loss; without both labels the model is their share alone."""
    if not len(x):
        x, y = np.zeros((1, len(FEATURES))), np.array([0.5])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(float(np.log(share / (1 - share))), _edges(x, BINS), [], _edges(x, PAIR_BINS), [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, p = model.bins(x, model.edges), model.bins(x, model.pair_edges)
    logit = np.full(len(x), model.base)
    if len(np.unique(y)) < 2:
        return model

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - prob, prob * (1 - prob)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, w = slopes()
            step = RATE * step_tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], w, len(t)), 3)
            t += step
            logit += step[b[:, j]]
    g, w = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
            cell = p[:, i] * shape[1] + p[:, j]
            gg, ww = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, w, shape[0] * shape[1])
            found.append((float((gg**2 / (ww + 5)).sum()), (i, j)))
    model.pairs = [pair for _, pair in sorted(found, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.grids):
            g, w = slopes()
            cell = p[:, i] * t.shape[1] + p[:, j]
            gg, ww = np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, w, t.size).reshape(t.shape)
            halves = step_tree(gg.sum(1), ww.sum(1), 2)
            step = np.zeros(t.shape)
            for value in np.unique(halves):
                side = halves == value
                step[side] = step_tree(gg[side].sum(0), ww[side].sum(0), 2)
            step *= RATE
            t += step
            logit += step[p[:, i], p[:, j]]
    return model


def _feature_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in text_bytes(batch.column("text"))]
        yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Gam:
    """Fit on at most ``fit_rows`` labelled documents whose id is not held out, chosen by hashed id.

    Labels other than 0 and 1 and null ids are left out; null and empty texts are texts whose statistics are all 0;
    very long texts are read whole; rows that repeat id and text count once; with no label at all every score is 0.5;
    other columns, whatever their names, are ignored.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("label")).where(crc_mod("id", 5) != 0)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = texts.select("id", F.xxhash64("text").alias("copy")).distinct().join(known, "id")
    share = hashed_share("id", "copy")
    # a hashed share near what is needed comes first, so that the exact choice sorts few rows wherever they are
    n = rows.count()
    near = rows.where(share <= 1.1 * fit_rows / max(1, n) + 1000 / max(1, n))
    chosen = written(near.orderBy(share, "id", "copy").limit(fit_rows), "labelled")
    rows = texts.withColumn("copy", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "copy"]).select("id", "label", "text")
    got = rows.mapInArrow(_feature_kernel, "id long, label int, x array<double>").distinct().toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["id"].to_numpy()))  # the order of repeated ids must not matter
    return fit(x[order], got["label"].to_numpy(np.float64)[order])


def scored(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row.

    Null and empty texts are scored as texts whose statistics are all 0; very long texts are read whole; repeated rows
    stay repeated and agree; a null id stays null; an empty table gives no rows; other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t) for t in text_bytes(batch.column("text"))])
                yield pa.record_batch([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, "id long, score double")


def accepted(docs: DataFrame, model: Gam, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``, all columns kept whatever their names.

    Null, empty, very long texts and repeated rows are scored as by :func:`scored`; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.array([features((t or "").encode()) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.where(score("text") >= cut)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
