"""Gram tables: distinct grams of each text, document frequencies, stop-grams.

Grams of words are made in kernels over Arrow batches; what only a few grams are asked of is decided there, so that the
others are never rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters, grams, keep_only, spaced

#: Grams that a kernel gives at a time, or counts before it lists those that are frequent among its texts.
TOGETHER = 200_000
COUNTED = 500_000
#: Grams up to which a set of them is sent to every kernel; larger ones are joined.
SENT = 1_000_000


def in_order(text: str | None, n: int) -> list[str]:
    """The n-grams of a text of :func:`spaced`, repeats included."""
    w = text.split(" ") if text else []
    return list(map(" ".join, zip(*(w[i:] for i in range(n)))))


def _exploded(texts: DataFrame, columns: dict[str, Column], text_col: str, n: int, places: bool, kept: Collection[str] | None = None) -> DataFrame:
    """``columns`` of each text and its grams: distinct ones, or with ``pos``; of ``kept`` alone if given."""
    made = texts.select(*(c.alias(k) for k, c in columns.items()), spaced(F.col(text_col)).alias("_text"))
    kept, own_names = None if kept is None else frozenset(kept), list(columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            at = pa.array(np.repeat(np.arange(first, i + 1), counts))
            own = [batch.column(c).take(at) for c in own_names]
            return pa.record_batch([*own, *([pa.array(pos, pa.int32())] if places else []), pa.array(found, pa.string())], names)

        names = [*own_names, *(["pos"] if places else []), "gram"]
        for batch in batches:
            first, counts, pos, found = 0, [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                g = in_order(text, n)
                if places:
                    own = [(p, x) for p, x in enumerate(g) if kept is None or x in kept]
                    pos.extend(p for p, _ in own)
                    g = [x for _, x in own]
                else:
                    g = list(dict.fromkeys(g) if kept is None else kept.intersection(g))
                counts.append(len(g))
                found.extend(g)
                if len(found) >= TOGETHER or i == batch.num_rows - 1:
                    yield rows()
                    first, counts, pos, found = i + 1, [], [], []

    types = [*(f"`{k}` {made.schema[k].dataType.simpleString()}" for k in columns), *(["pos int"] if places else []), "gram string"]
    return made.mapInArrow(kernel, ", ".join(types))


def gram_table(texts: DataFrame, id_col: str, text_col: str, n: int = 5, alphabet: str | None = None, kept: Collection[str] | None = None) -> DataFrame:
    """(id, gram): the distinct n-grams of each text; of words, or of the characters of ``alphabet`` if one is given.

    Of grams of words only those of ``kept`` are given, if there is such a set.
    """
    if alphabet is None:
        return _exploded(texts, {"id": F.col(id_col)}, text_col, n, False, kept)
    made = texts.select(F.col(id_col).alias("id"), characters(keep_only(F.col(text_col), alphabet)).alias("_tokens"))
    return made.select("id", F.explode(F.array_distinct(grams(F.col("_tokens"), n, ""))).alias("gram"))


def places(texts: DataFrame, n: int, kept: Collection[str] | None = None) -> DataFrame:
    """(id, pos, gram): the n-grams of words of (id, text) in order; those of ``kept`` alone, if there is such a set."""
    return _exploded(texts, {"id": F.col("id")}, "text", n, True, kept)


def sent(grams_: DataFrame, column: str = "gram") -> frozenset[str] | None:
    """The distinct grams of a small table, none (None) of one with more than ``SENT``."""
    own = grams_.select(column).distinct().limit(SENT + 1).toArrow()[column].to_pylist()
    return frozenset(own) if len(own) <= SENT else None


def document_frequency(grams_: DataFrame) -> DataFrame:
    return grams_.groupBy("gram").agg(F.count("*").alias("df"))


def _cutoff(n_texts: DataFrame, share: float, least: int = 0) -> DataFrame:
    return n_texts.agg(F.greatest(F.floor(F.count("*") * F.lit(share)), F.lit(least)).alias("cutoff"))


def stop_grams(frequency: DataFrame, n_texts: DataFrame, share: float = 0.05, least: int = 0) -> DataFrame:
    """Grams in more than floor(n * share) texts; below 1 / share texts that is every gram, as in the original rule."""
    return frequency.join(F.broadcast(_cutoff(n_texts, share, least)), F.col("df") > F.col("cutoff")).drop("cutoff")


def stops_of(texts: DataFrame, text_col: str, n: int, share: float) -> DataFrame:
    """(gram, df): the stop-grams of words of ``texts``, as of :func:`stop_grams`, without a row for any other gram.

    A gram in more than a share of all texts is in more than that share of some part of them. So those of parts are
    listed, and only they are counted over all texts; there are at most 1 / share times a text's mean number of grams.
    """
    plain = texts.select(spaced(F.col(text_col)).alias("_text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(counts: Counter, n_texts: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([g for g, k in counts.items() if k > share * n_texts - 1e-9], pa.string())], ["gram"])

        last, counts, seen = None, Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(set(in_order(text, n)))
                seen += 1
                if len(counts) >= COUNTED:
                    if last:
                        yield frequent(*last)
                    last, counts, seen = (counts, seen), Counter(), 0
        if last:  # a rest of few texts would list much
            last[0].update(counts)
            counts, seen = last[0], last[1] + seen
        if seen:
            yield frequent(counts, seen)

    asked = frozenset(plain.mapInArrow(listed, "gram string").distinct().toArrow()["gram"].to_pylist())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(asked.intersection(in_order(text, n)))
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "df"])

    frequency = plain.mapInArrow(counted, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    return stop_grams(frequency, plain, share)


def without(grams_: DataFrame, stops: DataFrame) -> DataFrame:
    return grams_.join(stops.select("gram"), "gram", "left_anti")


def set_sizes(grams_: DataFrame) -> DataFrame:
    return grams_.groupBy("id").agg(F.count("*").alias("n_grams"))


def sets_of(texts: DataFrame, columns: dict[str, Column], text_col: str, n: int, stops: Collection[str], hashes: bool = False) -> DataFrame:
    """``columns`` of each text and n_grams: how many distinct grams of words it has besides ``stops``.

    Texts without any are left out. With ``hashes`` a row for each gram: h and g, two 64-bit hashes, stand for it.
    """
    made = texts.select(*(c.alias(k) for k, c in columns.items()), spaced(F.col(text_col)).alias("_text"))
    stops, own_names, extra = frozenset(stops), list(columns), ["n_grams", *(["gram"] if hashes else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, found = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                g = set(in_order(text, n)) - stops
                if g:
                    at.append(i)
                    sizes.append(len(g))
                    if hashes:
                        found.extend(g)
                if at and (len(found) >= TOGETHER or i == batch.num_rows - 1):
                    by = [np.array(x) for x in (at, sizes)]
                    by = [pa.array(np.repeat(x, sizes) if hashes else x) for x in by]
                    own = [batch.column(c).take(by[0]) for c in own_names]
                    yield pa.record_batch([*own, by[1], *([pa.array(found, pa.string())] if hashes else [])], [*own_names, *extra])
                    at, sizes, found = [], [], []

    types = [*(f"`{k}` {made.schema[k].dataType.simpleString()}" for k in columns), "n_grams long", *(["gram string"] if hashes else [])]
    out = made.mapInArrow(kernel, ", ".join(types))
    return out.withColumn("h", F.xxhash64("gram")).withColumn("g", F.xxhash64(F.lit(1), "gram")).drop("gram") if hashes else out
