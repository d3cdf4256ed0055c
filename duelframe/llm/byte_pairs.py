"""Byte-level BPE encoding and decoding by length-bucketed matrices.

Texts are cut by the split pattern; pieces that are vocabulary entries are one token. All other pieces become rows of padded matrices of token
ids, one matrix for each bucket of lengths. In every round each row merges its leftmost pair of minimum rank: the ranks of neighbouring pairs
come from a hash table that is probed for all rows at once, the row is closed up over the merged pair, only the two pairs beside it are
looked up anew, and rows without a pair leave the matrix.

A row's rounds cost its length squared, so pieces over ``ROW_BYTES`` are rows of that many bytes first. A sequence of tokens is what the merges make
of its bytes exactly when that holds for every two neighbours, so only the seams are looked at: where two tokens do not stand beside each
other, a stretch around them is encoded again as a row, twice as long each time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.bpe import Merges
from duelframe.llm.common import map_batches, mix, whole_rows, with_row

#: Bytes of a row at most; longer pieces are several rows.
ROW_BYTES = 256
#: Bytes of a stretch that is still encoded as a row; what does not settle within it is merged with a heap.
STRETCH_BYTES = 4096
#: Cells of a matrix at most.
CELLS = 1 << 21
#: Pieces whose tokens a task keeps.
PIECES_KEPT = 500_000
#: Pieces of a text that are numbered at a time.
BLOCK_PIECES = 1 << 18
NONE = np.int32(np.iinfo(np.int32).max)
_NO_KEY = np.int64(-1)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts`` with ``sizes`` elements, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class PairTable:
    """(left id, right id) -> id of their concatenation, in a table with open addressing that is probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        self.mask = np.int64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, _NO_KEY)
        self.values = np.full(int(self.mask) + 1, NONE, np.int32)
        slots, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slots[rest]] == _NO_KEY]
            # of those that want one slot the last written one has it
            self.keys[slots[free]] = keys[free]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask
        self.values[slots] = merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(20)).view(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id (the rank) of every pair's concatenation, ``NONE`` where that is no entry or a side is padding (negative)."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NONE)
        rest = np.flatnonzero((held != keys) & (held != _NO_KEY))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (held != _NO_KEY)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Codec:
    """Encoder and decoder of a rank file (base64 of an entry and its rank to a line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # the library's \s is White_Space; regex has four separators more in it
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.single = np.array([self.ranks[bytes((b,))] for b in range(256)], np.int32)
        get = self.ranks.get
        triples = [
            (a, b, rank) for entry, rank in self.ranks.items() for k in range(1, len(entry))
            if (a := get(entry[:k])) is not None and (b := get(entry[k:])) is not None
        ]
        self.table = PairTable(*np.array(triples or [(0, 0, 0)], np.int64).T[:2], np.array([t[2] for t in triples] or [NONE], np.int32))
        size = max(self.ranks.values()) + 1
        entries = [b""] * size
        for entry, rank in self.ranks.items():
            entries[rank] = entry
        self.sizes = np.fromiter(map(len, entries), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.merges: Merges | None = None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text in blocks, so that a long text's pieces are not all held at once."""
        if len(text) < BLOCK_PIECES:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK_PIECES)):
            yield block

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of every row after all merges; rows are bucketed by length and cut into matrices of bounded size."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            # a bucket holds lengths up to the next power of two
            width = 1 << int(lengths[order[at]] - 1).bit_length()
            stop = int(min(np.searchsorted(lengths[order], width, "right"), at + max(1, CELLS // width)))
            own = order[at:stop]
            for i, ids in zip(own, self._merge([rows[i] for i in own], lengths[own])):
                out[i] = ids
            at = stop
        return out

    def _merge(self, rows: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        width = int(lengths.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[np.ndarray] = [ids[0, :0]] * len(rows)
        own, left = np.arange(len(rows)), lengths.copy()
        ranks = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(own), np.int64)
            low = ranks[np.arange(len(own)), best] if ranks.shape[1] else np.full(len(own), NONE)
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[own[i]] = ids[i, : left[i]].copy()
                go = ~done
                own, left, ids, ranks, best, low = own[go], left[go], ids[go], ranks[go], best[go], low[go]
                if not len(own):
                    return out
            n = np.arange(len(own))
            # close up over the right half of the merged pair
            left -= 1
            width = int(left.max())
            column = np.arange(width)
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), column + (column > best[:, None]), axis=1)
            ids[n, best] = low
            column = column[:-1]
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), column + (column >= best[:, None]), axis=1)
            for at in (best - 1, best):
                there = np.flatnonzero((at >= 0) & (at < width - 1))
                ranks[there, at[there]] = self.table.rank(ids[there, at[there]], ids[there, at[there] + 1])

    def stands(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of two tokens' bytes give back these two tokens."""
        pairs, back = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        merged = self.merge_rows([self.decode(np.array([p >> 32, p & 0xFFFFFFFF])) for p in pairs.tolist()])
        return np.array([len(m) == 2 and (int(m[0]) << 32 | int(m[1])) == p for m, p in zip(merged, pairs.tolist())])[back]

    def _settle(self, pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Tokens of long pieces from the tokens of their rows: stretches around seams that do not stand are encoded again until all do."""
        tokens = [np.concatenate(p) for p in pieces]
        seams = [np.cumsum([len(x) for x in p])[:-1] for p in pieces]
        reach = 4
        while True:
            asked = [(i, s) for i, own in enumerate(seams) for s in own.tolist()]
            if not asked:
                return tokens
            good = self.stands(np.array([tokens[i][s - 1] for i, s in asked]), np.array([tokens[i][s] for i, s in asked]))
            stretches: list[tuple[int, int, int]] = []
            for (i, s), fits in zip(asked, good):
                if fits:
                    continue
                lo, hi = max(0, s - reach), min(len(tokens[i]), s + reach)
                if stretches and stretches[-1][0] == i and lo <= stretches[-1][2]:
                    stretches[-1] = i, stretches[-1][1], hi
                else:
                    stretches.append((i, lo, hi))
            raw = [self.decode(tokens[i][lo:hi]) for i, lo, hi in stretches]
            short = [k for k, x in enumerate(raw) if len(x) <= STRETCH_BYTES]
            fresh: list[np.ndarray] = [self._heap(x) if len(x) > STRETCH_BYTES else x for x in raw]
            for k, ids in zip(short, self.merge_rows([raw[k] for k in short])):
                fresh[k] = ids
            parts: dict[int, list] = {}
            for (i, lo, hi), ids in zip(stretches, fresh):
                parts.setdefault(i, []).append((lo, hi, ids))
            seams = [np.zeros(0, np.int64)] * len(tokens)
            for i, own in parts.items():
                pieces_, marks, at, size = [], [], 0, 0
                for lo, hi, ids in own:
                    marks += [size + lo - at, size + lo - at + len(ids)]
                    pieces_ += [tokens[i][at:lo], ids]
                    size, at = marks[-1], hi
                tokens[i] = np.concatenate([*pieces_, tokens[i][at:]])
                marks = np.unique(marks)
                seams[i] = marks[(marks > 0) & (marks < len(tokens[i]))]
            reach *= 2

    def _heap(self, raw: bytes) -> np.ndarray:
        if self.merges is None:
            self.merges = Merges({k: v for k, v in self.ranks.items() if len(k) > 1})
        return np.array([self.ranks[x] for x in self.merges.merge(raw)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece: an entry is one token, any other piece what the merges make of it."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        rows, owner = [], []
        for i, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = np.array([known], np.int32)
            else:
                cut = [piece[k : k + ROW_BYTES] for k in range(0, len(piece), ROW_BYTES)]
                rows += cut
                owner.append((i, len(cut)))
        merged, at, long = self.merge_rows(rows), 0, []
        for i, n in owner:
            if n == 1:
                out[i] = merged[at]
            else:
                long.append((i, merged[at : at + n]))
            at += n
        for (i, _), ids in zip(long, self._settle([p for _, p in long])):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.sizes[ids])].tobytes()


class Numbers(dict):
    """Piece -> its number; pieces met for the first time wait in ``fresh`` for their tokens."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class Encoder:
    """Encodes texts and keeps the tokens of pieces seen lately, so that a repeated piece costs one look-up."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.reset()

    def reset(self) -> None:
        self.numbers, self.tokens = Numbers(), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(self) -> None:
        """Encode the pieces that wait."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            found = self.codec.encode_pieces([p.encode() for p in fresh])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.r_[self.starts, len(self.tokens) + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.tokens = np.concatenate([self.tokens, *found])

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of every text; the new pieces of all texts are encoded together."""
        if len(self.numbers) > PIECES_KEPT or len(self.tokens) > 8 * PIECES_KEPT:
            self.reset()
        asked: list[list[np.ndarray]] = []
        for text in texts:
            asked.append([np.fromiter(map(self.numbers.__getitem__, block), np.int64, len(block)) for block in self.codec.pieces(text)])
        self.settle()
        out = []
        for blocks in asked:
            found = [self.tokens[ragged(self.starts[b], self.sizes[b])] for b in blocks]
            out.append(found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int32), *found]))
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Strings of a column; null is empty, bytes that are no UTF-8 become replacement characters."""
    return [(x or b"").decode("utf-8", "replace") for x in batch.column(name).cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` with a column ``ids`` (array<int>): the text's ids by the ranks of ``path``, each match of ``pattern`` separately.

    Null and empty texts have no ids; special tokens are ordinary text. A column of the name ``ids`` is replaced, all others are kept. Bytes that are no
    UTF-8 are encoded as U+FFFD. Repeated rows stay; an empty table gives no rows.
    """
    rows = whole_rows(docs, F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch, encoder: Encoder) -> dict:
        found = encoder.encode(_texts(batch, "text"))
        offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
        return {"row": batch.column("row"), "found": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))}

    made = map_batches(rows, run, with_row(rows, "found array<int>"), setup=lambda: Encoder(codec(path, pattern)))
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != ids.lower()], F.col("found").alias(ids))


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with a column ``raw`` (binary): the bytes of their ids; null where ``ids`` is null or holds a null or an id outside the vocabulary."""
    rows = whole_rows(encoded, F.col(ids).cast("array<int>").alias("asked"))

    def run(batch: pa.RecordBatch, own: Codec) -> dict:
        def bytes_of(x: list | None) -> bytes | None:
            known = x is not None and all(i is not None and 0 <= i < len(own.sizes) and own.sizes[i] for i in x)
            return own.decode(np.array(x, np.int64)) if known else None

        return {"row": batch.column("row"), "made": [bytes_of(x) for x in batch.column("asked").to_pylist()]}

    made = map_batches(rows, run, with_row(rows, "made binary"), setup=lambda: codec(path, pattern))
    return made.select(*[F.col("row").getField(c).alias(c) for c in encoded.columns if c.lower() != raw.lower()], F.col("made").alias(raw))


def round_trips(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids as little-endian 32-bit integers and of the bytes decoded from them.

    Null text counts as empty; rows that repeat are repeated; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch, encoder: Encoder) -> dict:
        found = encoder.encode(_texts(batch, "text"))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) for x in found],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found],
            "decoded_sha256": [hashlib.sha256(encoder.codec.decode(x)).hexdigest() for x in found],
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", setup=lambda: Encoder(codec(path, pattern)))


