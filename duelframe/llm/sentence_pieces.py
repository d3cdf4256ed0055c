"""Encoding and decoding with a subword model as a weighted finite-state transducer.

The transducer is the composition of the normaliser (dummy prefix, blanks written as U+2581), the pieces, and byte fallback for
characters without a piece. An input is composed with it to a lattice, and its ids are the shortest path in the tropical semiring. In a
merge-trained model an arc weighs 0 where a piece is what the merges give beside the piece before it and is infinite otherwise
(``bpe.Merges.path``); adding up piece scores instead would not give the model's own segmentation. In a model without merges the
weights are the negated piece scores. Either way positions are relaxed once from left to right, so the work is linear in the text.
No piece continues past a blank that follows another character, nor past any two characters that occur together in no piece, so
inputs are composed part by part and short parts seen lately keep their path.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.bpe import Merges
from duelframe.llm.common import CACHE_LIMIT, map_batches

BLANK = "▁"
# Piece types and model types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
WEIGHTED, MERGED = 1, 2
#: Longest part whose path is kept.
KEPT_CHARS = 64


def _fields(buf: bytes):
    """(number, value) of a protocol-buffer message; messages and strings as bytes."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = buf[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = buf[i : i + size], i + size
        yield tag >> 3, value


class PieceTransducer(dict):
    """normalised word -> ids of its best path as little-endian int32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        trainer = dict(_fields(next(v for n, v in model if n == 2)))
        normaliser = dict(_fields(next((v for n, v in model if n == 3), b"")))
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("models that map characters or drop blanks are not compiled here")
        self.prefix = bool(normaliser.get(3, 1))
        self.merged = trainer.get(3, WEIGHTED) == MERGED
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.longest = max(map(len, self.ids))
        self.merges = Merges({p: -s for p, s in self.score.items() if len(p) > 1})
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.out = [b"" if kind in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() for p, _, kind in self.pieces]

    def best_path(self, word: str) -> list[str]:
        """Pieces on the shortest path; a character that is no piece is an arc by itself."""
        if self.merged:
            return self.merges.path(word)
        lowest = min(self.score.values()) - 10.0
        best: list[tuple[float, str]] = [(0.0, "")]
        for end in range(1, len(word) + 1):
            options = [
                (best[at][0] - self.score.get(word[at:end], lowest), word[at:end])
                for at in range(max(0, end - self.longest), end)
                if word[at:end] in self.ids or end - at == 1
            ]
            best.append(min(options))
        out, end = [], len(word)
        while end:
            out.append(best[end][1])
            end -= len(best[end][1])
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        if self.merged and len(parts := self.merges.cut(word)) > 1:
            value = b"".join([self[part] for part in parts])
        else:
            ids: list[int] = []
            for piece in self.best_path(word):
                known = self.ids.get(piece)
                if known is not None:
                    ids.append(known)
                elif self.bytes:
                    ids += [self.bytes[b] for b in piece.encode()]
                else:
                    ids.append(self.unknown)
            value = np.asarray(ids, "<i4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = value
        return value

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if not self.by_word:
            return self[(BLANK if self.prefix else "") + text.replace(" ", BLANK)]
        if self.prefix and "" not in words and BLANK not in text:
            return b"".join([self[BLANK + w] for w in words])
        normal = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        out, begin = [], 0
        for i in range(1, len(normal)):
            if normal[i] == BLANK and normal[i - 1] != BLANK:
                out.append(self[normal[begin:i]])
                begin = i
        return b"".join([*out, self[normal[begin:]]])

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        if self.prefix and raw.startswith(b" ") and len(ids) and self.pieces[ids[0]][2] != BYTE:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def _encode(batch: pa.RecordBatch, t: PieceTransducer) -> dict:
    parts = [t.encode(x or "") for x in batch.column("text").to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(parts), "<i4")
    decoded = [t.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    return {
        "doc_id": batch.column("doc_id"),
        "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
        "n_pieces": sizes,
        "decoded": decoded,
    }


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_pieces, decoded): the model's ids of every text and what decoding them gives.

    One row per row, repeated rows included. Null and empty texts have no ids and decode to the empty string; texts
    are whole, whatever their length. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _encode, "doc_id long, ids array<int>, n_pieces long, decoded string", setup=lambda: compiled(path))
