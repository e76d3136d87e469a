"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines.

Texts become hashed counts of byte trigrams of their lower-cased letters, scaled to unit length. One linear machine for
each family, against all others, chooses the family; within it each pair of languages has a machine of its own and the
language with most won pairs (then the largest summed margin) is predicted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, hashed_share, table, text_bytes, written

#: Bound of the documents of one language that a model is fitted on, chosen by hashed id.
FIT_ROWS = 400
#: Bound of the documents of all languages; with many languages each has fewer.
ALL_ROWS = 20_000
BUCKETS = 1 << 12
EPOCHS = 12
PENALTY = 1e-5
#: Words of the short sample that is added to the fit for each document.
SNIPPET = 3
# Families of language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {code: family for family, members in FAMILIES.items() for code in members}
_MAP = np.full(256, 32, np.uint8)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    """A language outside the list is a family of its own."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def vector(text: bytes) -> np.ndarray:
    """Hashed trigram counts of one UTF-8 text, damped by the square root and scaled to unit length."""
    a = _MAP[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    keep = np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]
    a = a[keep]
    if len(a) < 3:
        return np.zeros(BUCKETS, np.float32)
    code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
    x = np.sqrt(np.bincount(code, minlength=BUCKETS)).astype(np.float32)
    return x / np.sqrt(float(x @ x))


def has_letter(text: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def machine(x: np.ndarray, y: np.ndarray, seed: int = 42) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, averaged steps); ``y`` is +1 or -1, both balanced."""
    rng = np.random.default_rng(seed)
    w, total = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    t = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 2.0 / (1 + 0.002 * t)
            w *= 1 - rate * PENALTY
            if y[i] * (x[i] @ w) < 1:
                w += rate * balance[i] * y[i] * x[i]
        total += w
    return total / EPOCHS


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each row of ``x``: one product for the families, one for each family's pairs."""
        margins = x @ self.family_weights.T
        best = margins.argmax(1)
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        certain = sure(margins.max(1)) if len(self.families) > 1 else np.ones(len(x))
        names = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            members = [lang for lang in self.languages if family(lang) == name]
            own = np.flatnonzero(best == f)
            won, total = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
            pairs = list(itertools.combinations(range(len(members)), 2))
            if len(own) and pairs:
                m = x[own] @ np.stack([self.pair_weights[members[a], members[b]] for a, b in pairs]).T
                for k, (a, b) in enumerate(pairs):
                    won[:, a] += m[:, k] >= 0
                    won[:, b] += m[:, k] < 0
                    total[:, a] += m[:, k]
                    total[:, b] -= m[:, k]
            if len(own):
                most = won == won.max(1, keepdims=True)
                choice = np.where(most, total, -np.inf).argmax(1)
                names[own] = np.array(members, object)[choice]
                if pairs:
                    certain[own] *= sure(total[np.arange(len(own)), choice] / (len(members) - 1))
        return names.tolist(), certain


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    languages = sorted(set(langs))
    of = np.array([family(c) for c in langs])
    families = sorted(set(of))
    weights = np.stack([machine(x, np.where(of == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((len(families), BUCKETS))
    pairs = {}
    for a, b in itertools.combinations(languages, 2):
        if family(a) == family(b):
            own = np.isin(langs, (a, b))
            pairs[a, b] = machine(x[own], np.where(langs[own] == a, 1, -1))
    return Model(languages, families, weights, pairs)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` documents of each language, and ``ALL_ROWS`` of all, that are not held out.

    They are chosen by hashed id. Null languages, texts and ids are left out, as are texts without three letters; very
    long texts are read whole; rows that repeat id, language and text count once; other columns are ignored. Without any
    language the model is empty.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    own = own.select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    counts = written(own.groupBy("lang").count(), "counts")
    each = max(1, min(fit_rows, ALL_ROWS // max(1, counts.count())))
    share = hashed_share("id", "lang", "copy")
    keyed = own.select("id", "lang", F.xxhash64("text").alias("copy")).join(counts, "lang")
    # twice the rows that are needed, so that the ranking below stays small
    likely = keyed.where(share * F.col("count") <= 2 * each + 50).select("id", "lang", "copy").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(share, "id", "copy"))
    chosen = written(likely.withColumn("rank", rank).where(F.col("rank") <= each).select("id", "lang", "copy"), "languages")
    rows = own.withColumn("copy", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "lang", "copy"]).select("id", "lang", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                words = text.split()
                at = (i * 7919) % max(1, len(words) - SNIPPET)
                for part in (text, b" ".join(words[at : at + SNIPPET])):
                    x = vector(part)
                    some = np.flatnonzero(x)
                    if len(some):
                        yield pa.record_batch([pa.array([i], pa.int64()), pa.array([lang]), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([x[some]], pa.list_(pa.float32()))], ["id", "lang", "at", "x"])

    got = rows.mapInArrow(kernel, "id long, lang string, at array<int>, x array<float>").distinct().toPandas()
    got = got.assign(n=got["at"].map(len), sum=got["x"].map(sum)).sort_values(["id", "lang", "n", "sum"], kind="stable")
    x = np.zeros((len(got), BUCKETS), np.float32)
    for r, (at, value) in enumerate(zip(got["at"], got["x"])):
        x[r, at] = value
    return fit(x, got["lang"].to_numpy(object))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` with score 0 where the text is null or has no letter.

    Without any language to learn every text is ``und``. Very long texts are read whole; repeated rows stay repeated and
    agree; a null id stays null; an empty table gives no rows; other columns are ignored.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = text_bytes(part.column(1))
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                some = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
                if some:
                    names, certain = model.predict(np.stack([vector(texts[i]) for i in some]))
                    scores[some] = certain
                    for i, name in zip(some, names):
                        langs[i] = name
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, "id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
