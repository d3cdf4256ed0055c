"""Token counts by a deterministic transducer whose transitions carry the number of tokens that they emit.

The tokenizer is a pre-tokeniser followed by merges. Its transducer reads characters. A state names where the pre-tokeniser stands (inside letters, digits,
other characters, white space or the beginning of a contraction) and the state of the merges inside the piece (``bpe.Counter``); a transition
names the next state and by how much the number of tokens changes. States and transitions are compiled as texts ask for them and kept; reading a text is one look-up per character.

Texts are read in chunks, and a chunk's state map has the form (head, count, tail). Behind a blank between two non-blank characters the state is known whatever came before, so
what lies between the first and the last such blank is counted at once; the head depends on the state in which the chunk is entered,
and the tail names the state in which it is left. The beginning of a text is entered in the initial state and its end is final, so their maps are
closed on that side. Composing two neighbouring maps counts tail + head of the seam. A prefix scan over a text's chunks (a running count of
synchronised ones) numbers the seams, which are then counted by the same transducer.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm import bpe
from duelframe.llm.common import checkpoint, map_batches

CHUNK_CHARS = 1 << 16
#: Transitions that a task keeps; beyond that the transducer is compiled anew as needed.
MOVES = 1_000_000
SYNC = regex.compile(r" (?<=\S )(?=\S)")
_BLANK = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
# Contractions that the pre-tokeniser of the byte-level vocabulary splits off, by the letters after the apostrophe.
SHORT, LONG = ("s", "t", "m", "d"), {"r": "e", "v": "e", "l": "l"}
# Where the pre-tokeniser stands. SPACE has read a run of blanks but for its last, which may belong to what follows;
# QUOTE has read an apostrophe that begins a piece, SUFFIX one more letter that may begin a contraction.
START, SPACE, QUOTE, SUFFIX, LETTERS, DIGITS, OTHERS = range(7)


class State(dict):
    """character -> (next state, change of the token count)."""

    __slots__ = ("machine", "mode", "inner", "waiting")

    def __init__(self, machine: Transducer, mode: int, inner: tuple, waiting: str):
        super().__init__()
        self.machine, self.mode, self.inner, self.waiting = machine, mode, inner, waiting

    def __missing__(self, char: str) -> tuple[State, int]:
        move = self[char] = self.machine.compile(self, char)
        return move


class Transducer:
    """The byte-level tokenizer as a transducer over characters."""

    def __init__(self, path: str):
        merges, self.ids, specials = bpe.byte_level(path)
        self.counter = bpe.Counter(merges)
        self.states: dict[tuple, State] = {}
        self.moves = 0
        self.kinds: dict[str, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.start = self.state(START, self.counter.start, "")

    def state(self, mode: int, inner: tuple, waiting: str = "") -> State:
        key = (mode, inner, waiting)
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = State(self, mode, inner, waiting)
        return known

    def kind(self, char: str) -> int:
        found = self.kinds.get(char)
        if found is None:
            found = SPACE if _BLANK.match(char) else LETTERS if _LETTER.match(char) else DIGITS if _DIGIT.match(char) else OTHERS
            self.kinds[char] = found
        return found

    def read(self, inner: tuple, chars: str) -> tuple[tuple, int]:
        """The merges' state after some more characters of a piece, and the change of the count."""
        total = 0
        for byte in chars.encode("utf-8", "surrogatepass"):
            inner, change = self.counter.step(inner, bytes((byte,)))
            total += change
        return inner, total

    def compile(self, state: State, char: str) -> tuple[State, int]:
        if self.moves >= MOVES:
            # the states in use are let go when the text at hand ends
            self.states.clear()
            self.moves = 0
            self.start = self.state(START, self.counter.start, "")
        self.moves += 1
        return self.move(state.mode, state.inner, state.waiting, char)

    def move(self, mode: int, inner: tuple, waiting: str, char: str) -> tuple[State, int]:
        kind, fresh = self.kind(char), self.counter.start
        if mode == SPACE:
            if kind == SPACE:
                inner, n = self.read(inner, waiting)
                return self.state(SPACE, inner, char), n
            if waiting == " ":
                inner, n = self.read(fresh, " " + char)
                return self.state(kind, inner), n
            alone = self.read(fresh, waiting)[1]
            target, n = self.move(START, fresh, "", char)
            return target, alone + n
        if mode == QUOTE:
            if char in SHORT:
                return self.state(START, fresh), self.read(inner, char)[1]
            if char in LONG:
                return self.state(SUFFIX, inner, char), 0
            mode = OTHERS
        if mode == SUFFIX:
            if char == LONG[waiting]:
                return self.state(START, fresh), self.read(inner, waiting + char)[1]
            inner, begun = self.read(fresh, waiting)
            target, n = self.move(LETTERS, inner, "", char)
            return target, begun + n
        if kind == SPACE:
            return self.state(SPACE, fresh, char), 0
        if kind == mode:
            inner, n = self.read(inner, char)
            return self.state(mode, inner), n
        inner, n = self.read(fresh, char)
        return self.state(QUOTE if char == "'" else kind, inner), n

    def final(self, state: State) -> int:
        """What the end of the text adds: the character that a state still waits for."""
        if not state.waiting:
            return 0
        return self.read(state.inner if state.mode == SPACE else self.counter.start, state.waiting)[1]

    def count(self, text: str) -> int:
        """Tokens of a string that begins and ends between pieces."""
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(map(self.count, self.special.split(text)))
        state, n = self.start, 0
        for char in text:
            state, change = state[char]
            n += change
        return n + self.final(state)

    def chunk_map(self, text: str, begins: bool, ends: bool) -> tuple[str, int, str, bool]:
        """(head, count, tail, synchronised) of a chunk; head and tail are empty on the side where the chunk begins or ends its text."""
        if begins and ends:
            return "", self.count(text), "", True
        first = SYNC.search(text)
        if first is None:
            return text, 0, "", False
        last = first
        for last in SYNC.finditer(text, first.start()):
            pass
        lo, hi = 0 if begins else first.start(), len(text) if ends else last.start()
        return text[:lo], self.count(text[lo:hi]), text[hi:], True


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row, repeated rows included; null and empty texts have 0 tokens.

    Every text is read as chunks of ``chunk_chars`` characters, whose maps are composed; the chunks behind a text's first are dealt out
    over the tasks. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = ("row", "doc_id", "n_bytes", "n_chunks")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.greatest(F.lit(1), F.ceil(F.char_length("text") / F.lit(chunk_chars))).cast("int").alias("n_chunks"), "text",
    )

    def part(chunk: str) -> Column:
        return F.substring(F.col("text"), F.col(chunk) * chunk_chars + 1, F.lit(chunk_chars)).alias("text")

    first = rows.select(*ids, F.lit(0).alias("chunk"), "text").select(*ids, "chunk", part("chunk"))
    later = rows.where("n_chunks > 1").select(*ids, "text", F.explode(F.sequence(F.lit(1), F.col("n_chunks") - 1)).alias("chunk")).select(*ids, "chunk", part("chunk"))
    maps = checkpoint(map_batches(
        first.unionByName(later.repartition("row", "chunk")), _chunk_maps,
        "row long, doc_id long, n_bytes long, n_chunks int, chunk int, head string, n long, tail string, synced boolean", setup=lambda: transducer(path),
    ))
    earlier = Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    scan = maps.where("n_chunks > 1").withColumn("seam", F.coalesce(F.sum(F.col("synced").cast("int")).over(earlier), F.lit(0)))
    # a head joins the seam that its chunk finds open; a synchronised chunk then opens the next one with its tail
    both = F.array(
        F.struct(F.col("seam"), (F.col("chunk") * 2).alias("at"), F.col("head").alias("s"), F.lit(0).cast("long").alias("n")),
        F.struct((F.col("seam") + 1).alias("seam"), (F.col("chunk") * 2 + 1).alias("at"), F.col("tail").alias("s"), F.col("n")),
    )
    parts = scan.select(*ids, F.explode(F.when(F.col("synced"), both).otherwise(F.slice(both, 1, 1))).alias("p")).select(*ids, "p.*")
    seams = parts.groupBy(*ids, "seam").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"])).alias("s"), F.sum("n").alias("n")
    )
    counted = map_batches(
        seams.select(*ids, "s", "n"),
        lambda b, t: {"n_tokens": [t.count(x) + n for x, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist())]} | {k: b.column(k) for k in ids},
        "row long, doc_id long, n_bytes long, n_chunks int, n_tokens long",
        setup=lambda: transducer(path),
    )
    composed = counted.groupBy(*ids).agg(F.sum("n_tokens").alias("n_tokens")).select("doc_id", "n_bytes", "n_tokens")
    return maps.where("n_chunks = 1").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")).unionByName(composed)


def _chunk_maps(batch: pa.RecordBatch, t: Transducer) -> dict:
    ids = ("row", "doc_id", "n_bytes", "n_chunks", "chunk")
    chunks, n_chunks = batch.column("chunk").to_pylist(), batch.column("n_chunks").to_pylist()
    found = [t.chunk_map(x, k == 0, k == n - 1) for x, k, n in zip(batch.column("text").to_pylist(), chunks, n_chunks)]
    return {name: [x[i] for x in found] for i, name in enumerate(("head", "n", "tail", "synced"))} | {k: batch.column(k) for k in ids}
