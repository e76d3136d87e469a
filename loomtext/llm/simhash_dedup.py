"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's fingerprint is the 64-bit majority of the XXH64 values of its word shingles. To find all pairs of
fingerprints within four bits, the 64 bits are cut into segments of 23, 23 and 18 bits (the last padded), and each
segment is decoded with the perfect binary Golay code [23, 12, 7]. Every 23-bit word lies within 3 bits of one
codeword; a word exactly 3 away has five more at distance 4. Call these one or six codewords its *near set*.

* Segments at distance 1 or less: the decoded codeword of one is in the near set of the other.
* Segments at distance 2 or less: the two near sets share a codeword.

By pigeonhole four errors over three segments leave two segments (≤1, ≤1) or (0, 2, 2). The first case is found by
joining the decoded pair of one fingerprint (one row for each pair of segments) with the products of near sets of the
other, the second by one equal segment and a near set of another. All candidates are verified by their distance.

Only distinct fingerprints are joined, so copies cost nothing. A bucket gives a spanning forest of its links, never all
its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dealt, discard, free_name, hashed_share, sorted_runs, table, text_bytes, unite, written

SEED = 42
SHINGLE = 4
BITS = 4
#: Generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Runs up to this length are compared by shifting the whole array, longer ones one row against the run.
SHORT_RUN = 24
#: Of texts that are compared by similarity: words of a shingle, the least similarity, segments of 23 bits, 64-bit words
#: that hold them after the first, and differing bits of the first that candidates may have.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_SEGMENTS = 12
WIDE_WORDS = 6
WIDE_BITS = 18
#: Rows from which shingles are ordered by frequency, shingles listed as repeated there, bits of a set's parities, least
#: mean number of hashes in a part of a set that has several.
ORDER_ROWS = 10_000
ORDER_SHINGLES = 200_000
PARITIES = 1024
PART = 64
#: Hashes that count as one more row where sets are dealt; pairs of a row that are tested at a time.
ROW_HASHES = 200
TESTED = 256
#: Columns of a set's rarest hashes: keys; of each part how many of them it has, its size and its parities.
RARE = ["keys", "firsts", "sizes", "odds"]
#: Tasks over which the rows of one component are dealt.
SALTS = 32


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; for each syndrome up to six error patterns (own first), and how many."""
    high = np.array([_remainder(m << 11) for m in range(1 << 12)], np.int64)
    unit = [_remainder(1 << i) for i in range(23)]
    near: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            syndrome = pattern = 0
            for i in places:
                syndrome ^= unit[i]
                pattern |= 1 << i
            if weight < 4 or len(near[syndrome]) and bin(near[syndrome][0]).count("1") == 3:
                near[syndrome].append(pattern)
    count = np.array([len(x) for x in near], np.int64)
    patterns = np.array([x + [0] * (6 - len(x)) for x in near], np.int64)
    return high, patterns, count


_TABLES: list = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.extend(golay_tables())
    return tuple(_TABLES)


def near_codes(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (n, 6) of the near set of each 23-bit word, the decoded one first, and how many are valid."""
    high, patterns, count = _tables()
    syndrome = high[segment >> 11] ^ (segment & 0x7FF)
    return (segment[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def bucket_keys(fp: np.ndarray, probes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(key << 2 | role, row) of every bucket of the fingerprints; roles: 0 decoded, 1 near sets, 2 equal and near.

    Role 1 only looks up what role 0 lists and is left out without ``probes``.
    """
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    code, count = zip(*(near_codes(s) for s in seg))
    rows = np.arange(len(fp))
    keys, owners = [], []
    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        base = np.int64(kind) << 40
        keys.append((base | code[i][:, 0] << 12 | code[j][:, 0]) << 2)
        owners.append(rows)
        for a, b in itertools.product(range(6), range(6)) if probes else ():
            ok = (count[i] > a) & (count[j] > b)
            keys.append((base | code[i][ok, a] << 12 | code[j][ok, b]) << 2 | 1)
            owners.append(rows[ok])
        base = np.int64(kind + 4) << 40
        equal, other = kind, (kind + 1) % 3
        for a in range(6):
            ok = count[other] > a
            keys.append((base | seg[equal][ok] << 12 | code[other][ok, a]) << 2 | 2)
            owners.append(rows[ok])
    return np.concatenate(keys), np.concatenate(owners)


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text, unsigned; 0 where it has no word."""
    w = text.lower().split()  # bytes: lowers A-Z only and splits at \x20\x09-\x0D only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 200_000):
        h = np.fromiter((digest(b" ".join(w[i : i + shingle]), seed) for i in range(at, min(n, at + 200_000))), ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) of every row; fp holds the fingerprint's 64 bits. Null and wordless texts give 0."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle, seed) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, "id long, fp long")


def run_links(key: np.ndarray, role: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: all links of short runs, a spanning forest of each long run's."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    each = np.repeat(length, length)
    left, right = [], []
    short = (each > 1) & (each <= SHORT_RUN)
    sk, sr, sf = key[short], role[short], fp[short].view(np.uint64)
    for lag in range(1, min(SHORT_RUN, len(sk))):
        same = sk[lag:] == sk[:-lag]
        if not same.any():
            break
        i = np.flatnonzero(same & ((sr[lag:] != sr[:-lag]) | (sr[lag:] == 2)))
        i = i[np.bitwise_count(sf[i] ^ sf[i + lag]) <= bits]
        left.append(sf[i])
        right.append(sf[i + lag])
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        f, r = fp[s : s + n].view(np.uint64), role[s : s + n]
        nodes, at = np.unique(f, return_inverse=True)
        label = np.arange(len(nodes))
        probes = np.unique(at[r > 0])
        for i in np.unique(at[r != 1]):
            hits = probes[np.bitwise_count(nodes[probes] ^ nodes[i]) <= bits]
            met = unite(label, np.r_[i, hits])  # i for its own class, a hit for each other
            left.append(np.full(len(met), nodes[i]))
            right.append(nodes[met])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    return a[a != b], b[a != b]


def fingerprint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (src, dst) that connect all distinct fingerprints ``fp`` within ``bits`` (4 at most) of each other."""
    if not 0 <= bits <= BITS:
        raise ValueError("the segment scheme holds for 0 to 4 differing bits")

    def explode(batches: Iterator[pa.RecordBatch], probes: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy()
                if len(fp):
                    k, owner = bucket_keys(fp, probes)
                    yield pa.record_batch([pa.array(k >> 2), pa.array((k & 3).astype(np.int8)), pa.array(fp[owner])], ["key", "role", "fp"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in explode(batches, False):
            yield b.select(["key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            a, b = run_links(*(part.column(c).to_numpy() for c in ("run", "role", "fp")), bits)
            if len(a):
                yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])

    _tables()  # made once here and sent along with the kernel
    own = fps.select("fp")
    rows = own.mapInArrow(explode, "key long, role byte, fp long")
    # buckets that list many fingerprints are compared block by block, in tasks of bounded size
    units = dealt(rows, own.mapInArrow(listed, "key long"), "fp")
    return units.mapInArrow(verify, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(id, fp, component_id) of every row.

    Null, empty and wordless texts have fingerprint 0 and link like any other; repeated rows stay repeated; a null id
    keeps its row and never becomes a component's id (null if its component has no other); very long texts are read
    whole; an empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    linked = written(components(fingerprint_links(distinct, bits)).withColumnRenamed("node", "fp").join(distinct, "fp"), "linked")
    # one component may hold most fingerprints: its rows meet its smallest id in many tasks
    classes = linked.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(classes, ["root", "salt"]).select("fp", F.lit(True).alias("in_class"), "component_id")
    of_fp = written(distinct.join(named, "fp", "left").select("fp", F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")), "classes")
    return fps.join(of_fp, "fp").select("id", "fp", "component_id")


def shingle_hashes(text: bytes, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; of the whole sequence if it is shorter, none without a word."""
    w = text.lower().split()
    n = max(1, len(w) - shingle + 1) if w else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + shingle]), seed) for i in range(n)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Majority bits of a set of hashes in ``WIDE_SEGMENTS`` segments of 23 bits, after 64 bits that are compared whole."""
    total = np.zeros(64 * WIDE_WORDS, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 50_000):
            h = hashes[at : at + 50_000]
            words = [h]
            for k in range(1, WIDE_WORDS):  # further bits of a hash by mixing it with another constant
                x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                words.append(x ^ x >> np.uint64(31))
            bits = np.unpackbits(np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
            total += bits.sum(0, dtype=np.int32)
    return total * 2 > len(hashes)


def wide_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every bucket of rows of wide fingerprints: for each pair of segments all pairs of near codewords."""
    weights = np.int64(1) << np.arange(22, -1, -1)
    near = [near_codes(bits[:, 64 + 23 * i : 87 + 23 * i].astype(np.int64) @ weights) for i in range(WIDE_SEGMENTS)]
    keys, owners = [], []
    for kind in range(WIDE_SEGMENTS // 2):
        (x, nx), (y, ny) = near[2 * kind], near[2 * kind + 1]
        for a, b in itertools.product(range(6), range(6)):
            ok = np.flatnonzero((nx > a) & (ny > b))
            keys.append(np.int64(kind) << 24 | x[ok, a] << 12 | y[ok, b])
            owners.append(ok)
    return np.concatenate(keys), np.concatenate(owners)


def close_pairs(key: np.ndarray, node: np.ndarray, fp: np.ndarray, bits: int = WIDE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of a run that connect all of its nodes whose 64 bits differ in ``bits`` at most.

    Short runs are compared together and linked through the first close row; long ones give a spanning forest. Links
    that this leaves out, since a pair beside them fails the exact test, are left to :func:`crossing_pairs`.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    each = np.repeat(length, length)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    short = (each > 1) & (each <= SHORT_RUN)
    sk, sn, sf = key[short], node[short], fp[short].view(np.uint64)
    first, met = np.arange(len(sk)), []  # the first close row of the run; close rows
    for lag in range(1, min(SHORT_RUN, len(sk))):
        i = np.flatnonzero(sk[lag:] == sk[:-lag])
        if not len(i):
            break
        i = i[np.bitwise_count(sf[i] ^ sf[i + lag]) <= bits]
        first[i + lag] = np.minimum(first[i + lag], i)
        met.append((i, i + lag))
    for i, j in met:  # rows with the same first one are linked through it
        own = (first[i] != first[j]) | (first[j] == i)
        left.append(sn[i[own]])
        right.append(sn[j[own]])
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        f, own = fp[s : s + n].view(np.uint64), node[s : s + n]
        label = np.arange(n)
        for i in range(n):
            hits = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bits)
            met = unite(label, np.r_[i, hits])
            left.append(np.full(len(met), own[i]))
            right.append(own[met])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``PARITIES`` cells whether a set has an odd number of hashes there: sets differ in no fewer hashes than bits."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def rarest(hashes: np.ndarray, listed: np.ndarray, count: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the rarest hashes of each part of a set; of each part: how many these are, its size, its 64 parities.

    Parts are by the hash, ``PART`` to twice as many hashes in the mean, so that 64 parities tell parts apart however long the
    text is. Sets of the similarity reach it in a part at least, and there share one of the rarest hashes of each: those
    not ``listed``, then by ``count``. A set is cut once more as the shortest one that may be similar to it is cut.
    """
    n, least = len(hashes), int(np.ceil(similarity * len(hashes) - 1e-6))
    rank = np.zeros(n, np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        rank = np.where(listed[at] == hashes, count[at], 0)
    levels = [1 << max(0, (n // PART).bit_length() - 1)]
    while levels[-1] > 1 and least < PART * levels[-1]:
        levels.append(levels[-1] // 2)
    out = []
    for level in levels:
        part = (hashes >> np.uint64(20) & np.uint64(level - 1)).astype(np.int64)
        size = np.bincount(part, minlength=level)
        odd = np.bincount(part << 6 | (hashes & np.uint64(63)).astype(np.int64), minlength=level << 6) & 1
        odd = np.packbits(odd.astype(bool)).view(np.int64)
        first = np.where(size > 0, np.maximum(size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1, 0), 0)
        first = np.minimum(first, size)
        kept = np.arange(n) - np.repeat(np.cumsum(size) - size, size) < np.repeat(first, size)
        mixed = hashes[np.lexsort((hashes, rank, part))[kept]] + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append((mixed.view(np.int64) & (1 << 43) - 1, first[size > 0], size[size > 0], odd[size > 0]))
    return tuple(map(np.concatenate, zip(*out)))


def crossing_pairs(key: np.ndarray, node: np.ndarray, root: np.ndarray, at: np.ndarray, odd: np.ndarray, similarity: float = SIMILARITY, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of nodes of a run, of different roots, whose parts may have the similarity, some ``most`` pairs at a time.

    ``at``: size of the part << 32 | place of the shared hash among its rarest. Parts whose first shared hash it is share
    at most what follows in the shorter rest. So a pair may be left out of one run, never of that of its first shared hash.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    kept = np.repeat(mixed, np.diff(np.r_[start, len(key)]))
    if not kept.any():
        return
    key, node, root, size, odd = key[kept], node[kept], root[kept], at[kept] >> 32, odd[kept].view(np.uint64)
    rest = size - (at[kept] & (1 << 32) - 1)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[start, len(key)])
    shared, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.flatnonzero((key[i] == key[j]) & (root[i] != root[j]))
        i, j = i[ok], j[ok]
        both = size[i] + size[j]
        ok = (np.minimum(rest[i], rest[j]) >= shared * both - 1e-6) & (np.bitwise_count(odd[i] ^ odd[j]) <= apart * both + 1e-6)
        a, b = node[i[ok]], node[j[ok]]
        return np.maximum(a, b), np.minimum(a, b)

    short = np.flatnonzero(np.repeat(length, length) <= SHORT_RUN)
    for lag in range(1, min(SHORT_RUN, len(short))):
        yield met(short[:-lag], short[lag:])
    parts, held = [], 0
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN]):
        for i in range(s, s + n - 1):
            j = np.arange(i + 1, s + n)
            parts.append(met(np.full(len(j), i), j))
            held += len(parts[-1][0])
            if held > most or len(parts) > 10_000:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, held = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs that connect all that the pairs connect, without a cycle."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    left, right = [a[:0]], [b[:0]]
    while len(live := np.flatnonzero(parent[x] != parent[y])):
        x, y = x[live], y[live]
        high, low = np.maximum(parent[x], parent[y]), np.minimum(parent[x], parent[y])
        classes, first = np.unique(high, return_index=True)  # each hooks to one smaller class
        left.append(nodes[x[first]])
        right.append(nodes[y[first]])
        parent[classes] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return np.concatenate(left), np.concatenate(right)


def similar_pairs(node: np.ndarray, root: np.ndarray, block: np.ndarray, size: np.ndarray, values: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect all nodes of different roots whose sets have the similarity, by all pairs of the nodes.

    ``values``: the ascending hashes of the sets, one set after the other. Rows of one block (-1: none) met elsewhere.
    """
    label, end = np.unique(root, return_inverse=True)[1], np.cumsum(size)
    own = [values[e - n : e] for e, n in zip(end, size)]
    odd = np.frombuffer(b"".join(parities(x) for x in own), np.uint64).reshape(len(own), -1)
    apart = (1 - similarity) / (1 + similarity)
    left, right = [node[:0]], [node[:0]]
    for i in range(len(own) - 1 if label.any() else 0):
        other = (label[i + 1 :] != label[i]) & ((block[i + 1 :] != block[i]) | (block[i] < 0))
        both = size[i] + size[i + 1 :]
        j = i + 1 + np.flatnonzero(other & (np.abs(size[i] - size[i + 1 :]) <= apart * both + 1e-6))
        # sets of similar sizes whose parities allow it are compared in full
        j = j[np.bitwise_count(odd[j] ^ odd[i]).sum(1, dtype=np.int64) <= apart * (size[i] + size[j]) + 1e-6]
        for at in range(0, len(j), TESTED):
            k = j[at : at + TESTED]
            k = k[label[k] != label[i]]
            if not len(k):
                continue
            hashes = np.concatenate([own[x] for x in k])
            found = own[i][np.minimum(np.searchsorted(own[i], hashes), size[i] - 1)] == hashes
            shared = np.add.reduceat(found, np.cumsum(size[k]) - size[k], dtype=np.int64)
            k = k[shared >= similarity * (size[i] + size[k] - shared) - 1e-9]
            met = unite(label, np.r_[i, k])
            left.append(np.full(len(met), node[i]))
            right.append(node[met])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """(id, node, root) of every row: texts whose sets of word shingles have the Jaccard ``similarity`` or more are linked.

    Texts of that similarity differ in about a seventh of their fingerprint bits, far more than four of 64, so these
    fingerprints are wider: of each of ``WIDE_SEGMENTS // 2`` pairs of 23-bit segments all pairs of near codewords are
    buckets. Two segments share one with probability 0.61 at similarity 0.8 and 0.80 at 0.9, so pairs are found with
    probability 0.94 and 0.997. Candidates need ``WIDE_BITS`` equal bits of 64, then the sets themselves decide. A bucket
    gives pairs that connect its candidates, not all of them.

    The links that all this misses are found exactly: two sets of the similarity share a key of :func:`rarest` (in any
    order that is the same for all; here a sample's). Pairs that share one, that the first part did not put into one class,
    and that sizes, places and parities leave possible, grow with the square of a group of texts that are nearly similar.
    So a bucket gives a forest of them; sets that these connect meet, in blocks of bounded size, where every pair of
    different classes is tested, and give a forest of their links. So the classes are those of all pairs, and rows of
    this pass grow with the texts. ``node``: texts with equal sets; ``root``: the smallest node reachable. Null, empty and wordless texts are one
    node; ids should be unique or rows alike.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = [shingle_hashes(t, shingle, seed) for t in text_bytes(part.column(1))]
                node = np.array([xxhash.xxh64_intdigest(x.tobytes(), seed) for x in own], np.uint64).view(np.int64)
                packed = [np.packbits(wide_fingerprint(x)).tobytes() for x in own]
                rare = [listing([x.astype(np.int64) for x in column]) for column in zip(*(rarest(x, listed, count, similarity) for x in own))]
                columns = [pa.array(node), pa.array(packed, pa.binary()), pa.array([len(x) for x in own], pa.int32()), pa.array([parities(x) for x in own], pa.binary())]
                yield pa.record_batch([part.column(0).cast(pa.int64()), *columns, *rare], ["id", "node", "sig", "size", "parity", *RARE])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                key, owner = wide_keys(np.unpackbits(raw, axis=1))
                fp = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.int64)
                yield pa.record_batch([pa.array(key), pa.array(part.column("node").to_numpy()[owner]), pa.array(fp[owner])], ["key", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            a, b = close_pairs(*(part.column(c).to_numpy() for c in ("run", "node", "fp")))
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], ["src", "dst"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, first, size, odd = (part.column(c).flatten().to_numpy() for c in RARE)
                n = part.column("keys").value_lengths().to_numpy()
                place = np.arange(len(key)) - np.repeat(np.cumsum(first) - first, first)
                each = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("node", "root")]
                yield pa.record_batch([pa.array(key), *each, pa.array(np.repeat(size << 32, first) | place), pa.array(np.repeat(odd, first))], ["key", "node", "root", "at", "odd"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            held = [np.empty(0, np.int64)] * 2
            for pairs in crossing_pairs(*(part.column(c).to_numpy() for c in ("run", "node", "root", "at", "odd")), similarity):
                if len(pairs[0]):
                    held = forest(*map(np.concatenate, zip(held, pairs)))
            if len(held[0]):
                yield pa.record_batch([pa.array(np.maximum(*held)), pa.array(np.minimum(*held))], ["src", "dst"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, "run"):
            run = part.column("run").to_numpy()
            start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            for s, n in zip(start, np.diff(np.r_[start, len(run)])):
                unit = part.slice(s, n)
                hashes = unit.column("hashes").combine_chunks()
                columns = [unit.column(c).to_numpy() for c in ("node", "root", "block")]
                a, b = similar_pairs(*columns, hashes.value_lengths().to_numpy().astype(np.int64), hashes.flatten().to_numpy().view(np.uint64), similarity)
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["src", "dst"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITIES // 64) for c in ("p", "q"))
            sizes = batch.column("x").to_numpy() + batch.column("y").to_numpy()
            ok = np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * sizes + 1e-6
            yield batch.select(["src", "dst"]).filter(pa.array(ok))

    def listing(own: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), listing([shingle_hashes(t, shingle, seed).view(np.int64) for t in text_bytes(part.column(1))])], ["node", "hashes"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = nodes.join(distinct.select("node", F.col("rep").alias("id")), "node")
        return written(rows.join(asked, "id").dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, hashes array<long>"), "sets")

    def agreeing(pairs: DataFrame) -> DataFrame:
        bounds = distinct.select("node", "parity", "size")
        pairs = pairs.join(bounds.toDF("src", "p", "x"), "src").join(bounds.toDF("dst", "q", "y"), "dst").mapInArrow(possible, "src long, dst long")
        pairs = written(pairs, "pairs")
        own = sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        both = pairs.join(own.toDF("src", "x"), "src").join(own.toDF("dst", "y"), "dst").withColumn("shared", F.size(F.array_intersect("x", "y")))
        links = written(both.where(F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared")) - 1e-9).select("src", "dst"), "links")
        discard(own)
        return links

    def linked(pairs: DataFrame) -> DataFrame:
        groups = components(pairs).select("node", F.col("root").bitwiseAND((1 << 43) - 1).alias("key"))
        own = sets_of(groups.select("node"))
        units = groups.join(classes.select("node", "root"), "node").join(own, "node")
        # a long set counts as several rows, so that a unit's sets fit in memory
        counted = units.select("key", F.explode(F.sequence(F.lit(0), F.expr(f"size(hashes) div {ROW_HASHES}"))))
        links = written(dealt(units, counted.select("key"), "node").mapInArrow(within, "src long, dst long"), "links")
        discard(own)
        return links

    _tables()  # made once here and sent along with the kernels
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = rows.where(hashed_share("id") < ORDER_ROWS / max(1, rows.count())).select(F.xxhash64("text").alias("node"), "text").dropDuplicates(["node"])
    often = sample.mapInArrow(sets, "node long, hashes array<long>").select(F.explode("hashes").alias("hash")).groupBy("hash").count().where("count > 1")
    top = often.orderBy(F.desc("count"), "hash").limit(ORDER_SHINGLES).toArrow()
    listed, count = top["hash"].to_numpy().view(np.uint64), top["count"].to_numpy()
    listed, count = listed[by := np.argsort(listed)], count[by]
    fps = written(rows.mapInArrow(marks, f"id long, node long, sig binary, size int, parity binary, {', '.join(f'{c} array<long>' for c in RARE)}"), "signatures")
    first = F.min_by(F.struct("id", "sig", "size", "parity", *RARE), "id").alias("x")
    distinct = written(fps.groupBy("node").agg(first).select("node", F.col("x.id").alias("rep"), *(F.col(f"x.{c}") for c in ("sig", "size", "parity", *RARE))), "nodes")
    ids = written(fps.select("id", "node"), "ids")
    discard(fps)
    buckets = distinct.select("node", "sig").mapInArrow(spread, "key long, node long, fp long")
    near = agreeing(dealt(buckets, buckets.select("key"), "node").mapInArrow(compare, "src long, dst long").distinct())
    roots = components(near).withColumnRenamed("node", "_node")
    classes = distinct.select("node", *RARE).join(roots, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), *RARE)
    buckets = classes.mapInArrow(shared, "key long, node long, root long, at long, odd long")
    pairs = dealt(buckets, distinct.select(F.explode("keys").alias("key")), "node").mapInArrow(cross, "src long, dst long").distinct()
    links = roots.select(F.col("_node").alias("src"), F.col("root").alias("dst")).unionByName(linked(pairs))
    roots = components(links).withColumnRenamed("node", "_node")
    return ids.join(roots, F.col("node") == F.col("_node"), "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, one of each group of :func:`similar_texts`: the one with the smallest doc_id (null last), all columns kept.

    Null, empty and wordless texts are alike and one of them stays; very long texts are compared whole; of repeated rows,
    and of rows that agree in id and text, one stays; an empty table gives no rows. Columns may have any names.
    """
    key, mark = free_name(docs, "key"), F.xxhash64("doc_id", text_col, F.length(text_col))
    rows = docs.select(mark.alias("id"), F.col("doc_id").alias("doc"), F.col(text_col).alias("text"))
    found = similar_texts(rows, "id", "text", **options).select("id", "root").distinct()
    first = F.min_by("id", F.struct(F.col("doc").isNull(), "doc", "id")).alias(key)
    kept = found.join(rows.select("id", "doc").distinct(), "id").groupBy("root").agg(first).select(key)
    return docs.withColumn(key, mark).join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
