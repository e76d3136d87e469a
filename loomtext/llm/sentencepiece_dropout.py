"""SentencePiece encoding and decoding with seeded merge-dropout.

Texts are encoded with a public BPE model by agenda: of the neighbouring symbols of a chunk (a word with the spaces
before it) whose joined form is a piece, the best by the piece's rank, then place, comes up, and is merged, until none
is left. With dropout, each candidate that comes up is skipped with the given rate: a keyed hash of (seed, document's
variant, place of the chunk in the text, number of the candidate) decides, so every occurrence of a word draws its own
skips, reruns agree, and other seeds, documents and places give other segmentations. A skipped candidate comes up again
only as part of others. Merges are the model's own, so every result is a valid sequence of its pieces, and decoding
gives the text back. Rate 0 gives the model's own encoding.

The agendas of many chunks advance together: chunks of equal length are columns of one array, and each step takes the
best candidate of every column. Chunks of over ``WIDE`` symbols, which are rare, have a heap each.

Spaces become U+2581 with one more in front, as the model asks; a U+2581 of the text itself and characters without a
piece are written as byte pieces, so decoding is lossless for every text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 42
#: Keys of the documents; a document's hashed id chooses.
VARIANTS = 1 << 31
#: Symbols of a chunk up to which its agenda is a column of an array; longer ones have a heap.
WIDE = 64
#: Columns of one array, so that it stays in the processor's cache.
COLUMNS = 8192
#: Bytes of text that are encoded together.
TOGETHER = 1_000_000
SPACE = "▁"
_MASK = (1 << 64) - 1
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Stands for a symbol that has been merged into the one before it; rank of what is no candidate.
_GONE, _NONE = -1, (1 << 31) - 1
#: Bits of a symbol in a key of the merge table, and of a place in a packed candidate.
_BITS, _PLACE = 20, 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX[1])
    return x ^ x >> np.uint64(31)


def _mixed_int(x: int) -> int:
    x = (x ^ x >> 30) * _MIX[0] & _MASK
    x = (x ^ x >> 27) * _MIX[1] & _MASK
    return x ^ x >> 31


class Encoder:
    """One model with one rate and seed; ``encode`` takes a text and a variant."""

    def __init__(self, model: bytes, rate: float = RATE, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes.tolist()):
            self.raw[i] = bytes((b,))
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        by_rank = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.ranked = np.array(by_rank, np.int32)
        self.rate, self.seed = rate, seed
        self.limit = np.uint64(min(1.0, max(0.0, rate)) * 2.0**53)
        #: Pads short columns; merges with nothing.
        self.pad = len(self.pieces)
        if self.pad >> (_BITS - 1):
            raise ValueError("the vocabulary is too large for the merge table")
        self.of_char = np.full(0x110000, _GONE, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(" " if piece == SPACE else piece)] = i
        self.of_char[ord(SPACE)] = _GONE
        self._tabulate(by_rank)

    def _tabulate(self, by_rank: list[int]) -> None:
        """Merge table: open addressing from a pair of symbols to the rank of the piece that they make."""
        keys, ranks = [], []
        for rank, i in enumerate(by_rank):
            piece = self.pieces[i]
            if len(piece) > 1 and not all(c in self.ids for c in piece):
                raise ValueError("the model has a piece with a character that is none")
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << _BITS | right)
                    ranks.append(rank)
        self.shift = np.uint64(64 - max(10, (6 * len(keys)).bit_length()))
        self.table = np.full((1 << 64 - int(self.shift)) + 64, -1, np.int64)
        key, packed = np.array(keys, np.int64), np.array(keys, np.int64) << _BITS | np.array(ranks, np.int64)
        at = self._slot(key)
        while len(at):
            free = self.table[at] < 0
            self.table[at[free]] = packed[free]  # of several in one slot the last stays
            left = self.table[at] != packed
            at, packed = at[left] + 1, packed[left]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(_STEP)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair of symbols makes, or ``_NONE``."""
        key = left.astype(np.int64) << _BITS | right
        at = self._slot(key)
        got = self.table[at]
        out = np.where(got >> _BITS == key, got & ((1 << _BITS) - 1), _NONE)
        some = np.flatnonzero((got >= 0) & (got >> _BITS != key))
        while len(some):
            at[some] += 1
            got = self.table[at[some]]
            hit = got >> _BITS == key[some]
            out[some[hit]] = got[hit] & ((1 << _BITS) - 1)
            some = some[(got >= 0) & ~hit]
        return out

    def base(self, variant: int) -> int:
        return xxhash.xxh64_intdigest(variant.to_bytes(8, "little"), self.seed)

    def keys(self, bases: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Key of each chunk: by its text and its place among the text's chunks, from 0."""
        return _mixed(bases + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))

    def skipped(self, keys: np.ndarray, number: int) -> np.ndarray:
        """Whether the candidate that comes up as ``number``, from 0, is dropped in the chunk of each key."""
        return _mixed(keys + np.uint64((number + 1) * _STEP & _MASK)) >> np.uint64(11) < self.limit

    def merged(self, symbols: list[int], key: int) -> list[int]:
        """Pieces of one chunk, by a heap."""
        n = len(symbols)
        at: list[int] = list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks(np.array(symbols[:-1], np.int32), np.array(symbols[1:], np.int32)) if n > 1 else np.empty(0, np.int64)
        agenda = [(rank, left, symbols[left], symbols[left + 1]) for left, rank in enumerate(ranks.tolist()) if rank != _NONE]
        heapq.heapify(agenda)
        number, limit = 0, int(self.limit)

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                rank = int(self.ranks(np.array([at[left]], np.int32), np.array([at[right]], np.int32))[0])
                if rank != _NONE:
                    heapq.heappush(agenda, (rank, left, at[left], at[right]))

        while agenda:
            rank, left, a, b = heapq.heappop(agenda)
            right = after[left]
            if right < 0 or at[left] != a or at[right] != b:
                continue
            number += 1
            if _mixed_int(key + number * _STEP & _MASK) >> 11 < limit:
                continue
            at[left], at[right] = int(self.ranked[rank]), _GONE
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in at if s != _GONE]

    def merged_together(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Pieces of many chunks: ``symbols`` has a column for each, padded below; ``_GONE`` where one was merged away."""
        rows, n = symbols.shape
        out = np.empty((rows, n), np.int32)
        at = np.arange(n)
        sym = np.full((rows + 1, n), self.pad, np.int32)
        sym[:rows] = symbols
        best = np.full((rows, n), _NONE, np.int32)  # rank and place of the candidate that starts here
        for i in range(rows - 1):
            best[i] = self._packed(sym[i], sym[i + 1], i)
        after = np.repeat(np.arange(1, rows + 1, dtype=np.int8)[:, None], n, 1)
        before = np.repeat(np.arange(-1, rows, dtype=np.int8)[:, None], n, 1)
        number = 0
        while True:
            first = best.min(0)
            active = first != _NONE
            count = int(np.count_nonzero(active))
            if count < 0.75 * n or not count:
                out[:, at[~active]] = sym[:rows, ~active]
                if not count:
                    return out
                sym, best, after, before = (np.compress(active, x, axis=1) for x in (sym, best, after, before))  # contiguous
                first, keys, at, n = first[active], keys[active], at[active], count
                col = np.arange(n)
            else:
                col = np.flatnonzero(active)
                first = first[col]
            left = first & ((1 << _PLACE) - 1)
            drop = self.skipped(keys[col], number) if self.rate > 0 else np.zeros(len(col), bool)
            number += 1
            here = left * n + col
            best.ravel()[here[drop]] = _NONE
            keep = ~drop
            here, col, left, rank = here[keep], col[keep], left[keep], first[keep] >> _PLACE
            s, b, a, p = (x.ravel() for x in (sym, best, after, before))
            right = a[here].astype(np.int64) * n + col
            follow = a[right]
            piece = self.ranked[rank]
            s[here], s[right], b[right] = piece, _GONE, _NONE
            a[here] = follow
            beyond = follow.astype(np.int64) * n + col
            p[beyond] = left
            b[here] = self._packed(piece, s[beyond], left)
            some = np.flatnonzero(left)
            prior = p[here[some]].astype(np.int64)
            b[prior * n + col[some]] = self._packed(s[prior * n + col[some]], piece[some], prior)

    def _packed(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank == _NONE, _NONE, rank << _PLACE | place).astype(np.int32)

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First symbols of the texts, each with a space more in front; the starts of their chunks; each chunk's text."""
        char = np.frombuffer("".join([f" {t}" for t in texts]).encode("utf-32-le"), np.uint32)
        space = char == 32
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[text_at] = True
        starts = np.flatnonzero(start)
        owner = np.searchsorted(text_at, starts, "right") - 1
        sym = self.of_char[char]
        odd = np.flatnonzero(sym == _GONE)
        if len(odd):
            size = np.ones(len(char), np.int64)
            c = char[odd].astype(np.int64)
            more = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            size[odd] = more
            place = np.cumsum(size) - size
            sym = np.repeat(sym, size)
            for k in range(4):  # byte k of each character without a piece
                own = more > k
                tail = 6 * (more[own] - 1 - k)
                byte = c[own] >> tail
                byte = np.where(k == 0, np.where(more[own] == 1, byte, byte | np.array([0, 0, 0xC0, 0xE0, 0xF0])[more[own]]), 0x80 | byte & 0x3F)
                sym[place[odd[own]] + k] = self.bytes[byte]
            starts = place[starts]
        return sym, starts, owner

    def encode_all(self, texts: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and how many each text has."""
        sizes = np.zeros(len(texts), np.int64)
        filled = [i for i, t in enumerate(texts) if t]
        if not filled:
            return np.empty(0, np.int32), sizes
        sym, starts, owner = self._symbols([texts[i] for i in filled])
        length = np.diff(np.r_[starts, len(sym)])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        bases = np.array([self.base(variants[i]) for i in filled], np.uint64)
        keys = self.keys(bases[owner], np.arange(len(starts)) - first[owner])
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # chunks, their pieces by column
        order = np.argsort(length, kind="stable")
        ends = np.searchsorted(length[order], np.arange(WIDE + 1), "right")
        width = 0
        for step in (*range(1, 17), 20, 24, 32, 48, WIDE):
            rows = order[ends[width] : ends[step]]
            width = step
            for lo in range(0, len(rows), COLUMNS):
                some = rows[lo : lo + COLUMNS]
                place = np.arange(step)[:, None]
                inside = place < length[some]
                got = np.where(inside, sym[np.where(inside, starts[some] + place, 0)], self.pad)
                got = self.merged_together(got, keys[some])
                got[got == self.pad] = _GONE
                counts[some] = np.count_nonzero(got != _GONE, axis=0)
                done.append((some, got))
        heaped = [(i, self.merged(sym[starts[i] : starts[i] + length[i]].tolist(), int(keys[i]))) for i in order[ends[WIDE] :].tolist()]
        for i, got in heaped:
            counts[i] = len(got)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for some, got in done:
            alive = got != _GONE
            out[(at[some] + np.cumsum(alive, axis=0) - 1)[alive]] = got[alive]
        for i, got in heaped:
            out[at[i] : at[i] + len(got)] = got
        sizes[filled] = np.add.reduceat(counts, first)
        return out, sizes

    def encode(self, text: str, variant: int = 0) -> list[int]:
        """Piece ids of a whole text; none for an empty text."""
        return self.encode_all([text], [variant])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that :meth:`encode` had: pieces joined, byte pieces read as UTF-8, the leading space dropped."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file: read on the driver, where a public tokenizer is installed, and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


_SCHEMA = "id long, variant int, ids array<int>, lossless boolean"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """(id, variant, ids, lossless) of every row; lossless: the decoded ids are the text.

    Null and empty texts have no ids and are lossless; repeated rows stay repeated and agree; a null id takes variant
    0; very long texts are encoded whole, in memory of about 40 bytes a character; an empty table gives no rows; other
    columns are ignored.
    """
    proto = model_bytes(docs.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proto, rate, seed)
        for batch in batches:
            for part in slices(batch, most=TOGETHER):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, sizes = encoder.encode_all(texts, part.column("variant").to_pylist())
                ends = np.r_[0, np.cumsum(sizes)]
                each = ids.tolist()
                same = [encoder.decode(each[s:e]) == t for s, e, t in zip(ends.tolist(), ends[1:].tolist(), texts)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.record_batch([part.column("id"), part.column("variant"), lists, pa.array(same)], ["id", "variant", "ids", "lossless"])

    key = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("long")), F.lit(variants)), F.lit(0)).cast("int")
    key = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(key)
    return docs.select(F.col(id_col).cast("long").alias("id"), key.alias("variant"), F.col(text_col).alias("text")).mapInArrow(kernel, _SCHEMA)


def decoded(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of every row of ids: the encoded texts. Null ids give a null text, empty ones an empty text; repeated
    rows stay repeated; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    proto = model_bytes(rows.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proto, 0.0)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(kernel, "id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "variant", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")
