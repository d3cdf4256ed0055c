"""Conversation structure repair by a time-major tensor program.

A repaired conversation's role initials are ``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a). Conversations of like length are one
tensor of turns x conversations x states. A backward pass over the turns updates the state costs of all conversations at once and keeps them; a
forward pass then follows, again for all conversations at once, the ASCII-least edits whose cost is the one kept.

Conversations over ``BLOCK`` rows are blocks of that many rows, dealt over the tasks: a block's costs from every state to every state are min-plus
matrices, which are composed from a conversation's end to give each block the costs that follow it, then its exits from its start to give
each block its state. Only the digest of the repaired text, which is sequential by definition, walks through all of a conversation's blocks in one task, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import checkpoint, map_batches
from duelframe.operators.queries import numbered

#: Rows of a conversation that are repaired as one sequence.
BLOCK = 1024
#: Rows that a task turns into tensors at a time.
HELD_ROWS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_GAP = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: State that an inserted or reroled row leads to, and what inserts alone cost to the end.
_NEXT = np.array([2, 2, 3, 2])
_END = np.array([0, 2 * INSERT, INSERT, 0])
#: State that a kept row leads to, by state and role initial (s, u, a, any other); 4: it may not be kept.
_KEPT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
_LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLES = ("user", "assistant")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def prepared(messages: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows as they are, once each; null role and text are one space, ``conv`` is the conv_id as text, one space if null."""
    return messages.select(_text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), F.lit(1).alias("copies"))


def damaged(messages: DataFrame) -> DataFrame:
    """``prepared`` rows with faults by crc32(conv_id:turn) % 20: dropped (0 copies), emptied, without sentence ends, repeated (2 copies), role user."""
    rows = prepared(messages).withColumn("_k", F.crc32(F.concat_ws(":", "conv", _text("turn"))) % 20)
    k = F.col("_k")
    return rows.select(
        "conv", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )


def codes(roles: list[str]) -> np.ndarray:
    return np.array(["sua".find(r[0]) if r[:1] and r[0] in "sua" else 3 for r in roles], np.int8)


def fault(text: str, repeated: bool) -> int:
    """A row's first fault: blank, duplicate, truncated."""
    text = text.rstrip(_GAP)
    return _BLANK if not text else _DUPLICATE if repeated else _TRUNCATED if text[-1] not in ".!?" else _OK


def _relaxed(cost: np.ndarray) -> np.ndarray:
    """State costs where one or two inserts may come first."""
    return np.minimum(cost, np.minimum(INSERT + cost[..., _NEXT], 2 * INSERT + cost[..., _NEXT[_NEXT]]))


def _actions(code: np.ndarray, kind: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling a turn's rows from each state, given the costs after them (conversations x states)."""
    more = (TRUNCATED * (kind == _TRUNCATED))[:, None]
    padded = np.concatenate([after, np.full((len(after), 1), _FAR)], axis=1)
    target = _KEPT[:, code].T
    barred = ((kind == _BLANK) | (kind == _DUPLICATE))[:, None]
    keep = np.where(barred, _FAR, np.take_along_axis(padded, target, axis=1) + more)
    return after + DELETE, keep, np.where(barred, _FAR, after[:, _NEXT] + REROLE + more)


def backward(code: np.ndarray, kind: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs [turn, conversation, state] of repairing what is left from a turn on; ``ends`` are the costs after the last row."""
    out = np.empty((len(code) + 1, *ends.shape), np.int64)
    out[-1] = ends
    for t in range(len(code) - 1, -1, -1):
        best = np.minimum.reduce(_actions(code[t], kind[t], out[t + 1]))
        out[t] = np.where((t < sizes)[:, None], np.minimum(_relaxed(best), _FAR), out[t + 1])
    return out


def trace(code: np.ndarray, kind: np.ndarray, sizes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, roles, exit states): the ASCII-least cheapest edits of every conversation, three slots to a turn: two inserts, then what becomes of the row.

    Empty slots are 0; roles are those given (0 user, 1 assistant). ``last`` says where inserts may follow the last row.
    """
    turns, n = code.shape
    letters, roles = np.zeros((3 * turns + 2, n), np.uint8), np.zeros((3 * turns + 2, n), np.uint8)
    at, state = np.arange(n), state.copy()
    for t in range(turns + 1):
        inside = t < sizes
        may_insert = inside | (last & (t == sizes))
        delete = keep = reroled = np.full((n, 4), _FAR)
        if t < turns:
            delete, keep, reroled = _actions(code[t], kind[t], costs[t + 1])
        for slot in (3 * t, 3 * t + 1):
            now = costs[t, at, state]
            insert = may_insert & (INSERT + costs[t, at, _NEXT[state]] == now) & ~(inside & (delete[at, state] == now))
            letters[slot, insert], state = ord("I"), np.where(insert, _NEXT[state], state)
            roles[slot, insert] = state[insert] - 2
        if t < turns:
            now = costs[t, at, state]
            for letter, cost in (("R", reroled), ("K", keep), ("D", delete)):
                letters[3 * t + 2, inside & (cost[at, state] == now)] = ord(letter)
            row = letters[3 * t + 2]
            kept = _KEPT[state, code[t]]
            state = np.where(row == ord("K"), kept, np.where(row == ord("R"), _NEXT[state], state))
            roles[3 * t + 2] = np.maximum(state, 2) - 2
    return letters, roles, state


def _by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of conversations whose lengths have one next power of two."""
    bits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for b in np.unique(bits):
        yield np.flatnonzero(bits == b)


def _tensors(code: np.ndarray, kind: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major codes and kinds, and sizes, of the conversations ``own``."""
    sizes = np.diff(offsets)[own]
    there = np.arange(int(sizes.max(initial=0)))[:, None] < sizes
    where = np.where(there, offsets[own] + np.arange(len(there))[:, None], 0)
    return np.where(there, code[where] if len(code) else 3, 3), np.where(there, kind[where] if len(kind) else _BLANK, _BLANK), sizes


def _edits(letters: np.ndarray, given: np.ndarray, roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """(audit, repaired lines) of one conversation from its slots."""
    slots = np.flatnonzero(letters)
    lines, rows = [], iter(zip(roles, texts))
    for letter, new in zip(letters[slots].tolist(), given[slots].tolist()):
        if letter == 73:
            lines.append(f"{ROLES[new]}:")
            continue
        role, text = next(rows)
        if letter != 68:
            lines.append(f"{role if letter == 75 else ROLES[new]}:{text}")
    return letters[slots].tobytes().decode(), lines


def _turns(turns: np.ndarray, there: np.ndarray) -> tuple[int, int, int]:
    """(smallest, greatest, number of distinct turns), zeros if all are null."""
    own = np.unique(turns[there])
    return (int(own[0]), int(own[-1]), len(own)) if len(own) else (0, 0, 0)


def repair_whole(offsets: np.ndarray, turns: np.ndarray, there: np.ndarray, roles: list[str], texts: list[str]) -> dict[str, list]:
    """The columns of ``NAMES`` for conversations whose rows, in order, lie between ``offsets``; ``there`` marks turns that are not null."""
    n = len(offsets) - 1
    code, kind = codes(roles), np.zeros(len(roles), np.int8)
    for a, b in zip(offsets[:-1], offsets[1:]):
        seen: set[tuple[str, str]] = set()
        for i in range(a, b):
            row = roles[i], texts[i]
            kind[i] = fault(texts[i], row in seen)
            seen.add(row)
    out: dict[str, list] = {c: [0] * n for c in NAMES}
    for own in _by_length(np.diff(offsets)):
        c, k, sizes = _tensors(code, kind, offsets, own)
        costs = backward(c, k, sizes, np.tile(_END, (len(own), 1)))
        letters, given, _ = trace(c, k, sizes, costs, np.zeros(len(own), int), np.ones(len(own), bool))
        for j, i in enumerate(own):
            a, b = offsets[i], offsets[i + 1]
            audit, lines = _edits(letters[:, j], given[:, j], roles[a:b], texts[a:b])
            low, high, distinct = _turns(turns[a:b], there[a:b])
            out["gaps"][i] = high - low + 1 - distinct if distinct else 0
            for name, fault_ in (("blank", _BLANK), ("duplicate", _DUPLICATE), ("truncated", _TRUNCATED)):
                out[name][i] = int((kind[a:b] == fault_).sum())
            out["illegal"][i] = sum(p not in _LEGAL for p in zip(code[a : b - 1].tolist(), code[a + 1 : b].tolist()))
            out["cost"][i], out["audit"][i] = int(costs[0, j, 0]), audit
            out["repaired_sha256"][i] = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return out


def _strings(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of at most ``BLOCK`` rows, each read whole from one sorted partition."""
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")

    def done(rows_: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows_).combine_chunks()
        conv, copies = t.column("conv").to_pylist(), t.column("copies").to_numpy()
        names = list(dict.fromkeys(conv))
        number = {c: i for i, c in enumerate(names)}
        kept = np.repeat(np.arange(len(conv)), copies)
        sizes = np.bincount(np.array([number[conv[i]] for i in kept], np.int64), minlength=len(names))
        turn = t.column("turn")
        values, there = turn.fill_null(0).to_numpy()[kept], turn.is_valid().to_numpy()[kept]
        roles, texts = ([x[i] for i in kept] for x in (_strings(t.column("role")), _strings(t.column("text"))))
        out = repair_whole(np.r_[0, np.cumsum(sizes)], values, there, roles, texts)
        ids = pa.array([None if c == " " else int(c) for c in names], pa.int64())
        return pa.record_batch([ids, *[pa.array(out[c], pa.int64() if c not in NAMES[-2:] else pa.string()) for c in NAMES]], names=["conv_id", *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_ROWS):
                piece = batch.slice(at, HELD_ROWS)
                conv = piece.column("conv")
                # the last conversation may go on in what follows
                split = conv.index(conv[-1]).as_py() if piece.num_rows else 0
                before = held and held[-1].column("conv")[-1].as_py() != conv[0].as_py()
                if before or split:
                    whole = [*held, piece.slice(0, split)] if split else held
                    yield done([w for w in whole if w.num_rows])
                    held = []
                held.append(piece.slice(split))
        if held := [h for h in held if h.num_rows]:
            yield done(held)

    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, RESULT)


_BLOCK_ROW = "conv string, block long"


def _block_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], list[str], list]]:
    """(codes, kinds, roles, texts, turns) of every block of a batch."""
    for rows in batch.column("rows").to_pylist():
        roles, texts = [r["role"] for r in rows], [r["text"] for r in rows]
        yield codes(roles), np.array([fault(r["text"], not r["first"]) for r in rows], np.int8), roles, texts, [r["turn"] for r in rows]


def _per_block(blocks: DataFrame, fn: Callable, more: str, extra: tuple[str, ...] = ()) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {}
        given = [batch.column(c).to_pylist() for c in extra]
        for i, block in enumerate(_block_arrays(batch)):
            for name, value in fn(*block, *[g[i] for g in given]).items():
                out.setdefault(name, []).append(value)
        return {"conv": batch.column("conv"), "block": batch.column("block")} | out

    return map_batches(blocks, run, f"{_BLOCK_ROW}, {more}")


def _one(code: np.ndarray, kind: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(code[:, None], times, 1), np.repeat(kind[:, None], times, 1), np.full(times, len(code))


def _transfer(code, kind, roles, texts, turns) -> dict:
    ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
    costs = backward(*_one(code, kind, 4), ends)[0]
    low, high, distinct = _turns(np.array([t or 0 for t in turns]), np.array([t is not None for t in turns]))
    return {
        "moves": costs.T.ravel().tolist(), "blank": int((kind == _BLANK).sum()), "duplicate": int((kind == _DUPLICATE).sum()), "truncated": int((kind == _TRUNCATED).sum()),
        "illegal": sum(p not in _LEGAL for p in zip(code[:-1].tolist(), code[1:].tolist())), "begin": int(code[0]), "end": int(code[-1]), "low": low, "high": high, "distinct": distinct,
    }


def _exits(code, kind, roles, texts, turns, after, final) -> dict:
    args = _one(code, kind, 4)
    costs = backward(*args, np.tile(np.array(after), (4, 1)))
    return {"exits": trace(*args, costs, np.arange(4), np.full(4, final))[2].tolist()}


def _written(code, kind, roles, texts, turns, after, final, entry) -> dict:
    args = _one(code, kind, 1)
    costs = backward(*args, np.array([after]))
    letters, given, _ = trace(*args, costs, np.array([entry]), np.array([final]))
    audit, lines = _edits(letters[:, 0], given[:, 0], roles, texts)
    return {"audit": audit, "lines": "\n".join(lines), "empty": not lines}


def _after(key: tuple, t: pa.Table) -> pa.Table:
    """Costs that follow each block of a conversation, and the conversation's counts at its first one."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    costs, out = _END, []
    for r in reversed(rows):
        out.append({"conv": r["conv"], "block": r["block"], "after": costs.tolist(), "final": r is rows[-1]} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost")))
        costs = (np.array(r["moves"]).reshape(4, 4) + costs).min(axis=1)
    first, have = out[-1], [r for r in rows if r["distinct"]]
    first["cost"] = int(costs[0])
    for name in ("blank", "duplicate", "truncated"):
        first[name] = sum(r[name] for r in rows)
    first["illegal"] = sum(r["illegal"] for r in rows) + sum((a["end"], b["begin"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
    distinct = sum(r["distinct"] for r in have) - sum(a["high"] == b["low"] for a, b in zip(have, have[1:]))
    first["gaps"] = have[-1]["high"] - have[0]["low"] + 1 - distinct if have else 0
    return pa.Table.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.int64())), ("final", pa.bool_()), *[(c, pa.int64()) for c in NAMES[:6]]]))


def _entries(key: tuple, t: pa.Table) -> pa.Table:
    state, out = 0, []
    for r in sorted(t.to_pylist(), key=lambda r: r["block"]):
        out.append({"conv": r["conv"], "block": r["block"], "entry": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int32())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations whose blocks come in order; one block's text is held at a time."""
    now, audit, sha, begun, facts = None, [], hashlib.sha256(), False, {}

    def result() -> pa.RecordBatch:
        row = {"conv_id": None if now == " " else int(now)} | facts | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in NAMES[:6]], *[(c, pa.string()) for c in NAMES[6:]]]))

    for batch in batches:
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if r["conv"] != now:
                if now is not None:
                    yield result()
                now, audit, sha, begun, facts = r["conv"], [], hashlib.sha256(), False, {c: r[c] for c in NAMES[:6]}
            audit.append(r["audit"])
            if not r["empty"]:
                sha.update((b"\n" if begun else b"") + r["lines"].encode("utf-8", "surrogatepass"))
                begun = True
    if now is not None:
        yield result()


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length, by blocks of ``block`` rows."""
    each = rows.where("copies > 0").select("conv", "turn", "role", "text", F.explode(F.expr("sequence(1, copies)")).alias("_copy")).withColumn("_tie", F.monotonically_increasing_id())
    placed = numbered(each, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie"), F.col("_copy"))
    base = placed.groupBy("conv").agg((F.min("position")).alias("_base"))
    placed = checkpoint(placed.join(base, "conv").select("conv", "turn", "role", "text", (F.col("position") - F.col("_base")).alias("at"), F.sha2("text", 256).alias("_sha")))
    firsts = placed.groupBy("conv", "role", "_sha").agg(F.min("at").alias("_first"))
    flagged = placed.join(firsts, ["conv", "role", "_sha"]).select("conv", F.floor(F.col("at") / block).alias("block"), F.struct("at", "turn", "role", "text", (F.col("at") == F.col("_first")).alias("first")).alias("row"))
    blocks = checkpoint(flagged.groupBy("conv", "block").agg(F.array_sort(F.collect_list("row")).alias("rows")))
    moves = _per_block(blocks, _transfer, "moves array<long>, blank long, duplicate long, truncated long, illegal long, begin int, end int, low long, high long, distinct long")
    facts = ", ".join(f"{c} long" for c in NAMES[:6])
    # one row for each block of a conversation
    after = checkpoint(moves.groupBy("conv").applyInArrow(_after, f"{_BLOCK_ROW}, after array<long>, final boolean, {facts}"))
    held = blocks.join(after, ["conv", "block"])
    exits = _per_block(held, _exits, "exits array<int>", ("after", "final"))
    entries = checkpoint(exits.groupBy("conv").applyInArrow(_entries, f"{_BLOCK_ROW}, entry int"))
    written = _per_block(held.join(entries, ["conv", "block"]), _written, "audit string, lines string, empty boolean", ("after", "final", "entry"))
    whole = written.join(after.select("conv", "block", *NAMES[:6]), ["conv", "block"])
    return whole.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_digests, RESULT)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``rows`` (from ``prepared`` or ``damaged``): conv_id and the columns of ``NAMES``.

    Rows are taken by turn (null first), then role and text; copies lie beside each other. A conversation without rows (0 copies) has zeros, an
    empty audit and the digest of nothing. A null conv_id is a conversation of its own. Role initials other than s, u and a, and an empty role, are never kept. An empty table
    gives no rows. Counts of conversations are written once; those over ``block`` rows go by blocks.
    """
    counts = checkpoint(rows.groupBy("conv").agg(F.sum("copies").alias("_n")))
    long = counts.where(F.col("_n") > block).select("conv")
    if not long.limit(1).count():
        return _short(rows)
    return _short(rows.join(long, "conv", "left_anti")).unionByName(_long(rows.join(long, "conv", "left_semi"), block))


#: By a recursion over the turns from the last one, with whole edits and texts as values; crc32 bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE
crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
base AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keyed AS (SELECT base.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM base, crc_table),
hurt AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM keyed WHERE k <> 0),
rows_ AS (SELECT conv, turn, role, text FROM hurt UNION ALL SELECT conv, turn, role, text FROM hurt WHERE k = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
judged AS MATERIALIZED (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind, left(role, 1) AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS p, max(i) OVER (PARTITION BY conv) AS n
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM placed)),
facts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE kind = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv),
step AS (
  SELECT conv, n AS i, {'c': 0, 'a': '', 'x': ''} AS b0, {'c': 4, 'a': 'II', 'x': E'user:\nassistant:\n'} AS b1, {'c': 2, 'a': 'I', 'x': E'assistant:\n'} AS b2, {'c': 0, 'a': '', 'x': ''} AS b3 FROM judged WHERE i = n
  UNION ALL
  SELECT conv, i - 1,
    least(r0, {'c': r2.c + 2, 'a': 'I' || r2.a, 'x': E'user:\n' || r2.x}, {'c': r3.c + 4, 'a': 'II' || r3.a, 'x': E'user:\nassistant:\n' || r3.x}),
    least(r1, {'c': r2.c + 2, 'a': 'I' || r2.a, 'x': E'user:\n' || r2.x}, {'c': r3.c + 4, 'a': 'II' || r3.a, 'x': E'user:\nassistant:\n' || r3.x}),
    least(r2, {'c': r3.c + 2, 'a': 'I' || r3.a, 'x': E'assistant:\n' || r3.x}),
    least(r3, {'c': r2.c + 2, 'a': 'I' || r2.a, 'x': E'user:\n' || r2.x})
  FROM (SELECT s.conv, s.i,
      least({'c': b0.c + 3, 'a': 'D' || b0.a, 'x': b0.x}, {'c': b2.c + 2 + m, 'a': 'R' || b2.a, 'x': 'user:' || j.text || E'\n' || b2.x},
        CASE c WHEN 's' THEN {'c': b1.c + m, 'a': 'K' || b1.a, 'x': role || ':' || j.text || E'\n' || b1.x} WHEN 'u' THEN {'c': b2.c + m, 'a': 'K' || b2.a, 'x': role || ':' || j.text || E'\n' || b2.x} END) AS r0,
      least({'c': b1.c + 3, 'a': 'D' || b1.a, 'x': b1.x}, {'c': b2.c + 2 + m, 'a': 'R' || b2.a, 'x': 'user:' || j.text || E'\n' || b2.x},
        CASE c WHEN 'u' THEN {'c': b2.c + m, 'a': 'K' || b2.a, 'x': role || ':' || j.text || E'\n' || b2.x} END) AS r1,
      least({'c': b2.c + 3, 'a': 'D' || b2.a, 'x': b2.x}, {'c': b3.c + 2 + m, 'a': 'R' || b3.a, 'x': 'assistant:' || j.text || E'\n' || b3.x},
        CASE c WHEN 'a' THEN {'c': b3.c + m, 'a': 'K' || b3.a, 'x': role || ':' || j.text || E'\n' || b3.x} END) AS r2,
      least({'c': b3.c + 3, 'a': 'D' || b3.a, 'x': b3.x}, {'c': b2.c + 2 + m, 'a': 'R' || b2.a, 'x': 'user:' || j.text || E'\n' || b2.x},
        CASE c WHEN 'u' THEN {'c': b2.c + m, 'a': 'K' || b2.a, 'x': role || ':' || j.text || E'\n' || b2.x} END) AS r3
    FROM step s JOIN (SELECT *, CASE kind WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END AS m FROM judged) j ON j.conv = s.conv AND j.i = s.i)),
best AS (SELECT conv, b0 FROM step WHERE i = 0),
ids AS (SELECT DISTINCT conv, conv_id FROM base)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b0.c, 0)::BIGINT AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(left(b0.x, greatest(length(b0.x) - 1, 0)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (conv) LEFT JOIN best USING (conv)
"""
