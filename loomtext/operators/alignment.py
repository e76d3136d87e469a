"""Seed-and-extend alignment: seeds and diagonal islands as joins, the order-dependent steps as a grouped kernel.

The kernel works on sequences of tokens (characters of one script, words of another). Its steps: longest seeds, merging
on diagonals, early exit, gapped extension, chaining, tiling of the digest, and a phonetic rescan of what stays novel.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Collection, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import grams, words
from ..params import PhoneticParams, ReuseParams
from .grams import places as gram_places
from .grams import sent


def _kgrams(texts: DataFrame, k: int, tokens: Callable[[Column], Column], kept: Collection[str] | None = None) -> DataFrame:
    if tokens is words:
        return gram_places(texts.select("id", "text"), k, kept).withColumnRenamed("gram", "kgram")
    split = texts.select("id", tokens(F.col("text")).alias("w"))  # a column of its own: not split anew for each gram
    return split.select("id", F.posexplode(grams(F.col("w"), k)).alias("pos", "kgram"))


def seed_hits(digests: DataFrame, sources: DataFrame, k: int, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """(digest_id, source_id, d_pos, s_pos): all places where k tokens agree; an equi-join on the k-gram.

    Where digests have few k-grams of words, others of the sources are never rows.
    """
    d = _kgrams(digests, k, tokens).select(F.col("id").alias("digest_id"), F.col("pos").alias("d_pos"), "kgram")
    s = _kgrams(sources, k, tokens, sent(d, "kgram") if tokens is words else None).select(F.col("id").alias("source_id"), F.col("pos").alias("s_pos"), "kgram")
    return d.join(s, "kgram").select("digest_id", "source_id", F.col("d_pos").cast("long").alias("d_pos"), F.col("s_pos").cast("long").alias("s_pos"))


def diagonal_runs(hits: DataFrame, k: int) -> DataFrame:
    """(digest_id, source_id, d_start, d_end, s_start, s_end): maximal runs of hits on each diagonal."""
    diagonal = F.col("s_pos") - F.col("d_pos")
    place = F.row_number().over(Window.partitionBy("digest_id", "source_id", "_diag").orderBy("d_pos"))
    runs = hits.withColumn("_diag", diagonal).withColumn("_run", F.col("d_pos") - place).groupBy("digest_id", "source_id", "_diag", "_run")
    return runs.agg(F.min("d_pos").alias("d_start"), (F.max("d_pos") + k).alias("d_end"), F.min("s_pos").alias("s_start"), (F.max("s_pos") + k).alias("s_end")).drop("_diag", "_run")


def longest_seeds(runs: DataFrame, k: int) -> DataFrame:
    """(digest_id, source_id, d_pos, s_pos, len): for each start position the longest match, then the earliest source."""
    each = runs.withColumn("d_pos", F.explode(F.sequence("d_start", F.col("d_end") - k)))
    each = each.withColumn("len", F.col("d_end") - F.col("d_pos")).withColumn("s_pos", F.col("s_start") + F.col("d_pos") - F.col("d_start"))
    best = F.max_by(F.struct("len", "s_pos"), F.struct("len", -F.col("s_pos"))).alias("best")
    return each.groupBy("digest_id", "source_id", "d_pos").agg(best).select("digest_id", "source_id", "d_pos", "best.s_pos", "best.len")


class Span(NamedTuple):
    d_start: int
    d_end: int
    s_start: int
    s_end: int
    kind: str


def index_kgrams(source: Sequence[str], k: int) -> dict[tuple[str, ...], list[int]]:
    places: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(source) - k + 1):
        places[tuple(source[i : i + k])].append(i)
    return places


def find_seeds(digest: Sequence[str], source: Sequence[str], k: int, places: dict | None = None) -> list[tuple[int, int, int]]:
    """(d, s, length) of the longest match at every digest position; a run is measured once for its whole diagonal."""
    places = index_kgrams(source, k) if places is None else places
    run_end: dict[int, int] = {}
    out = []
    for d in range(len(digest) - k + 1):
        best = None
        for s in places.get(tuple(digest[d : d + k]), ()):
            end = run_end.get(s - d, 0)
            if end < d + k:
                end = d + k
                while end < len(digest) and s + end - d < len(source) and digest[end] == source[s + end - d]:
                    end += 1
                run_end[s - d] = end
            if best is None or end - d > best[2]:
                best = (d, s, end - d)
        if best:
            out.append(best)
    return out


def merge_diagonals(seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Touching seeds of a diagonal become one; diagonals stay in the order in which they were first met."""
    lines: dict[int, list[list[int]]] = {}
    for d, s, n in seeds:
        runs = lines.setdefault(s - d, [])
        if runs and d <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], d + n)
        else:
            runs.append([d, d + n])
    return [(a, a + off, b - a) for off, runs in lines.items() for a, b in runs]


def stretch(a: Sequence[str], b: Sequence[str], p: ReuseParams) -> tuple[int, int]:
    """Tokens of ``a`` and ``b`` that the best-scoring common prefix takes, one-token gaps and mismatches allowed.

    A mismatch that skipping one token of ``a`` resolves takes two of it; else one of ``b``; else both go on.
    """
    i = j = score = top = 0
    reach = (0, 0)
    while i < len(a) and j < len(b) and score >= p.fuzzy_stop:
        if a[i] == b[j]:
            score, step = score + p.match_score, (1, 1)
        else:
            skip_a = i + 1 < len(a) and a[i + 1] == b[j]
            skip_b = j + 1 < len(b) and a[i] == b[j + 1]
            score, step = score + p.mismatch_score, (2, 1) if skip_a else (1, 2) if skip_b else (1, 1)
        i, j = i + step[0], j + step[1]
        if score > top:
            top, reach = score, (i, j)
    return reach


def extend(digest: Sequence[str], source: Sequence[str], seed: tuple[int, int, int], p: ReuseParams) -> Span:
    d, s, n = seed
    ahead = stretch(digest[d + n :], source[s + n :], p)
    back = stretch(digest[:d][::-1], source[:s][::-1], p)
    kind = "fuzzy" if ahead[0] or back[0] else "exact"
    return Span(d - back[0], d + n + ahead[0], s - back[1], s + n + ahead[1], kind)


def chain(spans: list[Span], optimal: bool = False) -> list[Span]:
    """Spans that do not overlap in the digest, chosen by weighted scheduling over their ends.

    By default a span continues the chain that *ends* with the last span before it, which is not always the best
    earlier chain, and of neighbours one of which holds the other the larger stays; results are defined that way.
    ``optimal`` weighs all spans and continues the best chain.
    """
    kept: list[Span] = []
    for x in sorted(spans, key=lambda x: x.d_end):
        if not optimal and kept and kept[-1].d_start <= x.d_start and x.d_end <= kept[-1].d_end:
            continue
        if not optimal and kept and x.d_start <= kept[-1].d_start:
            kept[-1] = x
        else:
            kept.append(x)
    ends = [x.d_end for x in kept]
    total: list[int] = []
    link: list[int] = []
    lead: list[int] = []  # of the best chain among the first spans
    for i, x in enumerate(kept):
        j = bisect_right(ends, x.d_start, 0, i) - 1
        if optimal and j >= 0:
            j = lead[j]
        weight = x.d_end - x.d_start
        gain = total[j] if j >= 0 else 0
        total.append(weight + gain)
        link.append(j if gain > 0 else -1)
        lead.append(i if not lead or total[i] > total[lead[-1]] else lead[-1])
    out = []
    i = lead[-1] if lead else -1
    while i >= 0:
        out.append(kept[i])
        i = link[i]
    return out[::-1]


def tile(spans: list[Span], length: int) -> list[Span]:
    """The chosen spans and novel ones between them, from 0 to ``length``."""
    out, at = [], 0
    for x in [*spans, Span(length, length, -1, -1, "end")]:
        if x.d_start > at:
            out.append(Span(at, x.d_start, -1, -1, "novel"))
        if x.kind != "end":
            out.append(x)
            at = x.d_end
    return out


def phonetic_seeds(digest: Sequence[str], source: Sequence[str], table: dict[str, frozenset[str]], p: PhoneticParams) -> list[Span]:
    """Runs of equal or equivalent tokens with enough different ones; source places in ascending order, up to a cap."""
    wanted = frozenset().union(*(table.get(c, frozenset()) for c in digest))
    places: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(source):
        for syllable in table.get(c, frozenset()) & wanted:
            places[syllable].append(i)
    out, d = [], 0
    while d <= len(digest) - p.seed_length:
        starts = sorted({i for x in table.get(digest[d], ()) for i in places.get(x, ())})[: p.max_positions]
        best = (0, 0)
        for s in starts:
            n = different = 0
            for a, b in zip(digest[d:], source[s:]):
                if a != b:
                    if not table.get(a, frozenset()) & table.get(b, frozenset()):
                        break
                    different += 1
                n += 1
            if n >= p.seed_length and different >= p.least_different and n > best[0]:
                best = (n, s)
        if best[0]:
            out.append(Span(d, d + best[0], best[1], best[1] + best[0], "phonetic"))
        d += best[0] or 1
    return out


def phonetic_mapping(digest: Sequence[str], source: Sequence[str], table: dict[str, frozenset[str]]) -> list[tuple[str, str, str]]:
    """(digest token, syllable, source token) for each place; '=' equal without one, '?' without a shared one."""
    if len(digest) != len(source):
        raise ValueError("only sequences of equal length map")
    out = []
    for a, b in zip(digest, source):
        mine, theirs = table.get(a, frozenset()), table.get(b, frozenset())
        shared = mine if a == b else mine & theirs
        out.append((a, min(shared, default="=" if a == b else "?"), b))
    return out


def align(digest: Sequence[str], source: Sequence[str], p: ReuseParams, places: dict | None = None, table: dict[str, frozenset[str]] | None = None, phonetic: PhoneticParams | None = None) -> list[Span]:
    """Tiling of the digest by matched and novel spans; an empty digest has none."""
    if not digest:
        return []
    seeds = merge_diagonals(find_seeds(digest, source, p.seed_length, places))
    enough = sum(n for _, _, n in seeds) / len(digest) >= p.early_exit_coverage
    spans = tile(chain([extend(digest, source, x, p) for x in seeds]) if enough else [], len(digest))
    if not table:
        return spans
    phonetic = phonetic or PhoneticParams()
    out = []
    for x in spans:
        part = digest[x.d_start : x.d_end]
        if x.kind != "novel" or len(part) < phonetic.seed_length or not any(c in table for c in part):
            out.append(x)
            continue
        for y in tile(chain(phonetic_seeds(part, source, table, phonetic)), len(part)):
            out.append(y._replace(d_start=y.d_start + x.d_start, d_end=y.d_end + x.d_start))
    return out


_SEGMENT = "digest_id long, source_id long, segment int, digest_start long, digest_end long, source_start long, source_end long, match_type string"


def align_pairs(pairs: DataFrame, digests: DataFrame, sources: DataFrame, p: ReuseParams, tokens: Callable[[Column], Column] = words, table: dict[str, frozenset[str]] | None = None, together: int = 64) -> DataFrame:
    """Segments of every pair. Pairs of one source share its index; those of a much-used source are dealt by ``together``.

    ``pairs``: (digest_id, source_id); those flagged ``from_phonetic``, if there is such a column, were found by sound
    already and are not looked through for it again. Pairs with an unknown text are left out.
    """
    d = digests.select(F.col("id").alias("digest_id"), tokens(F.col("text")).alias("d"))
    s = sources.select(F.col("id").alias("source_id"), F.col("text").alias("_text"))
    known = F.col("from_phonetic") if "from_phonetic" in pairs.columns else F.lit(False)
    own = pairs.groupBy("digest_id", "source_id").agg(F.max(known).alias("known"))
    groups = own.groupBy("source_id").agg(F.ceil(F.count("*") / together).cast("int").alias("groups"))
    # the source's tokens go once to each group, not once to each pair
    keyed = own.join(groups, "source_id").join(d, "digest_id").withColumn("part", F.pmod(F.xxhash64("digest_id"), F.col("groups")).cast("int")).drop("groups")
    # texts are split into tokens once it is known that they are needed
    needed = keyed.select("source_id", "part").distinct().join(s, "source_id").select(F.col("source_id").alias("owner"), F.col("part").alias("share"), tokens(F.col("_text")).alias("s"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right) and len(left):
            source = list(right["s"].iloc[0])
            places = index_kgrams(source, p.seed_length)
            for digest_id, source_id, digest, known in zip(left["digest_id"], left["source_id"], left["d"], left["known"]):
                for i, x in enumerate(align(list(digest), source, p, places, None if known else table)):
                    rows.append((digest_id, source_id, i, *x))
        return pd.DataFrame(rows, columns=["digest_id", "source_id", "segment", "digest_start", "digest_end", "source_start", "source_end", "match_type"])

    return keyed.groupBy("source_id", "part").cogroup(needed.groupBy("owner", "share")).applyInPandas(kernel, _SEGMENT)
