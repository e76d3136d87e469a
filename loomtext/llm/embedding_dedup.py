"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Each table hashes a vector to the signs of its products with ``BITS`` seeded hyperplanes. Two vectors at cosine 0.95
agree in one sign with probability 0.899, so they share a bucket of at least one of 24 tables of 14 bits with
probability 0.998; links above the threshold are safer. A pair that meets in several tables counts in the first of them
only, which both rows can tell from their codes, so that no list of pairs is ever made distinct or even made.

Buckets are first made of codes alone, which are far shorter than vectors. A row stays in a bucket if its code differs in
few enough of all sign bits from that of another row that it meets there first; only then is its vector fetched. So a
vector travels about once for each bucket in which it has a partner, not once for each table. Vectors are compared in
double precision; a bucket gives counts for each vector and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dealt, sorted_runs, table, unite, written

THRESHOLD = 0.95
TABLES = 24
BITS = 14
SEED = 42
#: Standard deviations by which the differing sign bits of a candidate may exceed what a link at the threshold has on average.
MARGIN = 7.0
#: Runs up to this length are compared by shifting the whole array, longer ones by blocks of products.
SHORT_RUN = 16
BLOCK = 512
#: Pairs of codes that a long run compares at a time.
PAIRS_HELD = 1_000_000


def hyperplanes(dim: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def codes(x: np.ndarray, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Bucket of each row of ``x`` in each table, (n, tables) uint16."""
    signs = (x @ hyperplanes(x.shape[1], tables, bits, seed) > 0).reshape(len(x), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.uint16)


def most_bits(threshold: float = THRESHOLD, tables: int = TABLES, bits: int = BITS, margin: float = MARGIN) -> int:
    """Differing sign bits that a candidate may have: a link has more with a probability of about 1e-10."""
    p, n = np.arccos(np.clip(threshold, -1, 1)) / np.pi, tables * bits
    return int(np.ceil(n * p + margin * np.sqrt(n * p * (1 - p))))


def partnered(run: np.ndarray, block: np.ndarray, code: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Which rows of the runs have another whose codes differ in ``most`` bits at most and agree here for the first time."""
    n, tables = code.shape
    here = (run >> 20 >> bits).astype(np.int64)
    words = np.ascontiguousarray(np.pad(code, ((0, 0), (0, -tables % 4)))).view(np.uint64)
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[start, n])
    each = np.repeat(length, length)
    found = np.zeros(n, bool)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            ok = ((code[a] == code[b]).argmax(1) == here[a]) & ((block[a] < 0) | (block[a] != block[b]))
            found[a[ok]] = found[b[ok]] = True

    short = np.flatnonzero((each > 1) & (each <= SHORT_RUN))
    for a, b in _pairs(run[short]):
        for at in range(0, len(a), 200_000):
            i, j = short[a[at : at + 200_000]], short[b[at : at + 200_000]]
            near = np.bitwise_count(words[i] ^ words[j]).sum(1) <= most
            mark(i[near], j[near])
    for s, size in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        own, step = words[s : s + size], max(1, PAIRS_HELD // size)
        for at in range(0, size, step):
            rows = np.arange(s + at, s + min(size, at + step))
            rows = rows[~found[rows]]  # a row found already was found with each of its partners, or they look for it
            apart = np.zeros((len(rows), size), np.uint16)
            for k in range(own.shape[1]):
                apart += np.bitwise_count(words[rows, k][:, None] ^ own[None, :, k])
            r, c = np.nonzero(apart <= most)
            r, c = rows[r], s + c
            mark(r[r != c], c[r != c])
    return found


def _pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lag in range(1, min(SHORT_RUN, len(key))):
        i = np.flatnonzero(key[lag:] == key[:-lag])
        if not len(i):
            return
        yield i, i + lag


def bucket_links(run: np.ndarray, ident: np.ndarray, copies: np.ndarray, block: np.ndarray, x: np.ndarray, code: np.ndarray, threshold: float, bits: int) -> tuple[list, list]:
    """Counts [(ident, links)] and edges [(a, b)] of the runs; a pair counts in the first table where its codes agree."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    here = (run >> 20 >> bits).astype(np.int64)
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    length = np.diff(np.r_[start, len(run)])
    each = np.repeat(length, length)
    count = np.zeros(len(run), np.int64)
    edges = []
    short = np.flatnonzero((each > 1) & (each <= SHORT_RUN))
    for a, b in _pairs(run[short]):
        for at in range(0, len(a), 100_000):
            i, j = short[a[at : at + 100_000]], short[b[at : at + 100_000]]
            near = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[near], j[near]
            first = (code[i] == code[j]).argmax(1) == here[i]
            i, j = i[first], j[first]
            new = (block[i] < 0) | (block[i] != block[j])
            i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            edges.append((ident[i], ident[j]))
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        own = slice(s, s + n)
        unit, label = x[own], np.arange(n)
        for at in range(0, n, BLOCK):
            some = slice(at, min(n, at + BLOCK))
            near = unit[some] @ unit.T / (norm[own][some, None] * norm[own][None, :]) >= threshold
            rows, cols = np.nonzero(near)
            rows += at
            ok = rows != cols
            ok &= (block[s + rows] < 0) | (block[s + rows] != block[s + cols])
            rows, cols = rows[ok], cols[ok]
            first = np.empty(len(rows), bool)
            for part in range(0, len(rows), 200_000):
                cut = slice(part, part + 200_000)
                first[cut] = (code[s + rows[cut]] == code[s + cols[cut]]).argmax(1) == here[s]
            rows, cols = rows[first], cols[first]
            np.add.at(count, s + rows, copies[s + cols])
            for r, hits in zip(*_groups(rows, cols)):
                met = unite(label, np.r_[r, hits])
                edges.append((np.full(len(met), ident[s + r]), ident[s + met]))
    some = np.flatnonzero(count)
    return [(ident[some], count[some])], [(a[a != b], b[a != b]) for a, b in edges]


def _groups(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    heads, at = np.unique(rows, return_index=True)
    return heads, np.split(cols, at[1:]) if len(heads) else []


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    length never link. Equal vectors are compared once and count as linked; repeated ids are rows of their own. A null
    id keeps its row and never becomes a component's id. An empty table gives no rows; other columns are ignored.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.transform(x, lambda v: v + F.lit(0.0).cast("float"))).alias("v"))
    rows = written(rows.withColumn("same", F.unhex(F.sha2(F.to_json(F.struct("v")).cast("binary"), 256))), "vectors")
    groups = rows.where("v is not null").groupBy("same").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.first("v").alias("v"))
    groups = groups.withColumn("ident", F.xxhash64("same"))
    most = most_bits(threshold, tables, bits)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                v = b.column("v")
                size = np.diff(v.offsets.to_numpy())
                for dim in np.unique(size):
                    some = b.filter(pa.array(size == dim))
                    x = np.asarray(some.column("v").flatten()).reshape(-1, dim).astype(np.float64)
                    packed = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                    coded = pa.array([r.tobytes() for r in codes(x, tables, bits, seed)], pa.binary())
                    width = pa.array(np.full(len(x), dim, np.int32))
                    yield pa.record_batch([*(some.column(c) for c in ("same", "ident", "copies", "low")), width, packed, coded], ["same", "ident", "copies", "low", "width", "v", "codes"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                c = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint16).reshape(-1, tables)
                base = (b.column("width").to_numpy().astype(np.int64) & 0x3FF) << 33
                key = (base[:, None] | np.arange(tables, dtype=np.int64)[None, :] << bits | c).ravel()
                each = np.repeat(np.arange(b.num_rows), tables)
                yield pa.record_batch([pa.array(key), b.column("ident").take(each), b.column("codes").take(each)], ["key", "ident", "codes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            run, block = part.column("run").to_numpy(), part.column("block").to_numpy()
            code = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint16).reshape(-1, tables)
            found = pa.array(partnered(run & ((1 << 53) - 1), block, code, bits, most))
            yield from part.select(["run", "ident", "block"]).filter(found).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            run, ident, copies, block = (part.column(c).to_numpy() for c in ("run", "ident", "copies", "block"))
            packed = part.column("v").to_pylist()
            size = np.array([len(p) for p in packed])
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                x = np.frombuffer(b"".join(packed[i] for i in own), np.float32).reshape(len(own), -1).astype(np.float64)
                code = np.frombuffer(b"".join(part.column("codes").take(pa.array(own)).to_pylist()), np.uint16).reshape(len(own), tables)
                counts, edges = bucket_links(run[own] & ((1 << 53) - 1), ident[own], copies[own], block[own], x, code, threshold, bits)
                for kind, pairs in ((0, counts), (1, edges)):
                    a, b = (np.concatenate([p[i] for p in pairs] or [np.empty(0, np.int64)]) for i in (0, 1))
                    if len(a):
                        yield pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    signed = written(groups.mapInArrow(sign, "same binary, ident long, copies long, low long, width int, v binary, codes binary"), "groups")
    buckets = signed.select("ident", "width", "codes").mapInArrow(spread, "key long, ident long, codes binary")
    met = written(dealt(buckets, buckets.select("key"), "ident").mapInArrow(meet, "run long, ident long, block int"), "met")
    fetched = met.join(signed.select("ident", "copies", "v", "codes"), "ident").repartition("run").sortWithinPartitions("run", "ident")
    found = written(fetched.mapInArrow(verify, "kind int, a long, b long"), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("ident")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "ident")
    known = signed.select("same", "ident", "copies", "low").join(counts, "ident", "left").join(roots, "ident", "left").withColumn("root", F.coalesce("root", "ident"))
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(lows, "root").select("same", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    none = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.where("v is not null").join(known, "same").select("id", "n_links", "component_id").unionByName(none)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: All pairs, for tables on which that is no burden.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
linked AS (SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b ON a.r <> b.r AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {THRESHOLD}),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
lowest AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON v.r = y GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM linked GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN lowest ON lowest.x = v.r LEFT JOIN counts ON counts.x = v.r
"""
