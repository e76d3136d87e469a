"""Document fingerprints from closed syncmers over words, in DataFrame functions only.

A k-mer is K consecutive words; its inner substrings are the S-word substrings within it. It is a closed syncmer, and so
an anchor, if the smallest of their hashes stands first or last. Whether a k-mer is chosen depends on its own words
alone, so an edit moves no anchor elsewhere. Among INNER - 1 consecutive k-mers at least one is chosen, so texts of
SURE words or more always have an anchor; shorter texts are anchored at every word. A text of each side of that limit
share no anchor, however alike they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

K = 9
S = 2
#: Inner substrings of a k-mer; the sliding minimum below doubles its reach three times.
INNER = K - S + 1
#: Words from which on some k-mer is sure to be chosen.
SURE = K + INNER - 2
#: Rows of a range of ids, on average, that one window sorts; a range may be larger, as windows spill.
RANGE_ROWS = 500
MOST_RANGES = 1 << 14


def _slide(a: str, by: int) -> Column:
    """Minimum of each element and the one ``by`` further on."""
    kept = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, kept), F.slice(F.col(a), F.lit(by + 1), kept), lambda x, y: F.least(x, y))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of (at: word position from 0, hash: int), in the order of the text."""
    w, a, m, pick = (f"_{x}_{out}" for x in "wamp")
    n = F.size(w)
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    pairs = F.greatest(n - 1, F.lit(0))
    df = df.withColumn(a, F.zip_with(F.slice(w, 1, pairs), F.slice(F.col(w), F.lit(2), pairs), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn(m, _slide(a, 1)).withColumn(m, _slide(m, 2)).withColumn(m, _slide(m, 4))
    last = F.size(m)
    flags = F.zip_with(
        F.zip_with(F.slice(a, 1, last), F.col(m), lambda x, y: x == y),
        F.zip_with(F.slice(F.col(a), F.lit(INNER), last), F.col(m), lambda x, y: x == y),
        lambda first, final: first | final,
    )
    df = df.withColumn(pick, F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    long = F.transform(pick, lambda i: F.struct(i.alias("at"), F.shiftright(F.xxhash64(F.slice(F.col(w), i + 1, F.lit(K))), 32).cast("int").alias("hash")))
    short = F.transform(w, lambda h, i: F.struct(i.alias("at"), F.shiftright(F.xxhash64(F.array(h)), 32).cast("int").alias("hash")))
    return df.withColumn(out, F.when(n >= SURE, long).otherwise(short)).drop(w, a, m, pick)


def fingerprint(anchors: str) -> Column:
    """Eight hex digits for each anchor, in order."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x["hash"].cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: likeness of two fingerprints by the anchors that match in order, 0 to 1; 1 where both have none.

    The distinct anchors that both have stand in two orders, by their places in either text. ``in order`` are the first
    of them and each that follows the same anchor in both; their number is set against the mean of the distinct anchors.
    """
    x, y, p, q, pp, qq = (f"_{k}_{out}" for k in ("x", "y", "p", "q", "pp", "qq"))
    hashes = lambda c: F.array_distinct(F.transform(c, lambda e: e["hash"]))
    steps = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda u, v: F.xxhash64(u, v))
    df = df.withColumns({x: hashes(F.col(a)), y: hashes(F.col(b))})
    df = df.withColumns({p: F.array_intersect(x, y), q: F.array_intersect(y, x)})
    df = df.withColumns({pp: steps(p), qq: steps(q)})
    both = F.size(x) + F.size(y)
    in_order = F.when(F.size(p) > 0, 1 + F.size(F.array_intersect(pp, qq))).otherwise(0)
    return df.withColumn(out, F.when(both == 0, F.lit(1.0)).otherwise(2.0 * in_order / both)).drop(x, y, p, q, pp, qq)


def with_matches(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the anchors of ``a`` that ``b`` has too, with their first positions in both: array of (at, other_at).

    Anchors of both are sorted by hash, side and position, so that a match is a pair of neighbours.
    """
    u, f = f"_u_{out}", f"_f_{out}"
    side = lambda c, k: F.transform(c, lambda e: F.struct(e["hash"].alias("hash"), F.lit(k).alias("side"), e["at"].alias("at")))
    df = df.withColumn(u, F.array_sort(F.concat(side(a, 0), side(b, 1))))
    before = lambda i: F.get(F.col(u), i - 1)
    df = df.withColumn(f, F.filter(u, lambda e, i: (i == 0) | (before(i)["hash"] != e["hash"]) | (before(i)["side"] != e["side"])))
    after = lambda i: F.get(F.col(f), i + 1)
    pair = lambda e, i: F.when((e["side"] == 0) & (after(i)["hash"] == e["hash"]), F.struct(e["at"].alias("at"), after(i)["at"].alias("other_at")))
    return df.withColumn(out, F.array_sort(F.filter(F.transform(f, pair), lambda e: e.isNotNull()))).drop(u, f)


def id_ranges(ids: DataFrame) -> list[int]:
    """Ascending ids that cut the table into ranges of about ``RANGE_ROWS`` rows, at most ``MOST_RANGES``; the smallest id first."""
    low, n = ids.agg(F.min("id"), F.count("id")).first()
    if not n:
        return [0]  # null ids alone are one range
    k = min(MOST_RANGES, max(2, 1 << math.ceil(math.log2(max(1, n / RANGE_ROWS)))))
    at = F.percentile_approx("id", F.array(*(F.lit(i / k) for i in range(1, k))), F.lit(4 * k))
    return sorted({low, *ids.agg(at).first()[0]})


def range_of(col: str, bounds: list[int]) -> Column:
    """Index of the last bound that is not above the id, by binary search; null ids belong to the first range."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    known = F.lit([*bounds, *[(1 << 63) - 1] * (2 * steps[0] - len(bounds))])
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col(col), at + step).otherwise(at))
    return F.when(F.col(col).isNull(), F.lit(0)).otherwise(found)


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each column in ``carry``: that of the next row by (id, text), of the first row for the last.

    Rows are dealt by ranges of ids; a copy of each range's first row closes the range before it.
    """
    bounds = id_ranges(rows.select("id"))
    order = F.struct("id", "text")
    firsts = rows.where(F.col("id").isin(bounds) | F.col("id").isNull()).withColumn("_range", range_of("id", bounds))
    firsts = firsts.groupBy("_range").agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_range", "_row.*")
    closing = firsts.withColumn("_range", F.when(F.col("_range") == 0, len(bounds) - 1).otherwise(F.col("_range") - 1)).withColumn("_copy", F.lit(True))
    own = rows.withColumn("_range", range_of("id", bounds)).withColumn("_copy", F.lit(False))
    near = Window.partitionBy("_range").orderBy("_copy", "id", "text")
    return own.unionByName(closing).withColumns({f"next_{c}": F.lead(c).over(near) for c in carry}).where("not _copy").drop("_range", "_copy")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, anchors, edited_anchors, next_anchors) of every row.

    The edited text is the text with its last floor(n/2) code points replaced by as many first ones (or all) of the
    next document. Null texts read as empty; wordless texts have no anchors, and two such are alike (1.0); very long
    texts are read whole; rows of equal id are ordered by text, null ids come first; a single row follows itself; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(with_anchors(rows, "text", "anchors"), ["text", "anchors"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return with_anchors(rows.withColumn("edited", edited).drop("next_text"), "edited", "edited_anchors")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    pairs = with_likeness(with_likeness(pairs, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return pairs.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
