"""Byte-pair merges as a finite-state constraint on neighbouring tokens.

A sequence of tokens is what the merges make of its text exactly when that holds for every pair of
neighbours. So the merges of a text are the one path through its lattice of vocabulary entries on which all
neighbours are compatible: the shortest path where an arc weighs 0 if it fits the token before it and is infinite otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Hashable, Sequence
from heapq import heappop, heappush



class Merges:
    """Vocabulary entries over symbols (bytes or characters) with the rank at which each entry is merged.

    ``ranks`` gives the rank of every entry longer than one symbol; lower ranks merge first, the leftmost of
    equal ranks first. Entries are joined symbols, so two neighbours may merge when their concatenation is an entry.
    """

    def __init__(self, ranks: dict, pairs: dict | None = None):
        self.ranks = ranks
        self.pairs = pairs
        self._fits: dict[tuple[Hashable, Hashable], bool] = {}
        self._last: dict[Hashable, tuple | None] = {}
        # longest entry by its first two symbols, and all neighbouring symbols that occur inside an entry
        self._reach: dict = {}
        self._inside: set = set()
        for entry in ranks:
            head = entry[:2]
            if len(entry) > self._reach.get(head, 1):
                self._reach[head] = len(entry)
            self._inside.update(entry[i : i + 2] for i in range(len(entry) - 1))

    def _rank(self, left, right):
        return self.pairs.get((left, right)) if self.pairs is not None else self.ranks.get(left + right)

    def merge(self, text: Sequence, until: int = 1) -> list:
        """The merges applied step by step, best first, down to ``until`` parts; used on single entries, and as the tests' reference."""
        n = len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple] = []

        def offer(at: int) -> None:
            if end[at] < n and (rank := self._rank(text[at : end[at]], text[end[at] : end[end[at]]])) is not None:
                heappush(queue, (rank, at, end[at], end[end[at]]))

        for at in range(n):
            offer(at)
        left = n
        while queue and left > until:
            _, at, mid, stop = heappop(queue)
            # a part that was merged meanwhile has another end, or none
            if end[at] == mid and end[mid] == stop:
                end[at], end[mid], left = stop, -1, left - 1
                if stop < n:
                    before[stop] = at
                offer(at)
                if before[at] >= 0:
                    offer(before[at])
        out, at = [], 0
        while at < n:
            out.append(text[at : end[at]])
            at = end[at]
        return out

    def last_merge(self, token) -> tuple | None:
        """The two parts of an entry's last merge; None where its symbols merge to something else."""
        if token not in self._last:
            parts = self.merge(token, until=2)
            self._last[token] = tuple(parts) if len(parts) == 2 and self._rank(*parts) is not None else None
        return self._last[token]

    def stands(self, token) -> bool:
        """Whether merging a vocabulary entry's symbols gives the entry itself."""
        return len(token) == 1 or self.last_merge(token) is not None

    def fits(self, left, right) -> bool:
        """Whether merging left + right gives back exactly these two tokens.

        The merges of both sides are taken back, latest first. The two parts at the seam would have merged if their rank comes before
        the merges that took each of them up; of equal ranks the one further left comes first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self._fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left, right) -> bool:
        taken_left = taken_right = float("inf")
        rank = self.ranks.get
        if not (self.stands(left) and self.stands(right)):
            return False
        while True:
            seam = self._rank(left, right)
            if seam is not None and seam < taken_left and seam <= taken_right:
                return False
            r_left = rank(left, -1) if len(left) > 1 else -1
            r_right = rank(right, -1) if len(right) > 1 else -1
            if r_left < 0 and r_right < 0:
                return True
            if r_left > r_right:
                taken_left, left = r_left, self.last_merge(left)[1]
            else:
                taken_right, right = r_right, self.last_merge(right)[0]

    def cut(self, text: Sequence) -> list:
        """``text`` cut wherever two neighbouring symbols occur together in no entry, so that no token spans the cut."""
        inside, out, begin = self._inside, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                out.append(text[begin:i])
                begin = i
        out.append(text[begin:])
        return out

    def path(self, text: Sequence) -> list:
        """Tokens of ``text``: the shortest path through its lattice in the tropical semiring.

        A state is a position with the token that ends there. An arc to the next token weighs 0 if that fits and is infinite otherwise, so all
        states within reach are equally near and may be settled in any order: last found first, longest tokens first, which mostly goes straight
        to the end. Only one token of finite weight ends at a position, so a position that was left without reaching the end is
        settled for good, and the work is linear in the text.
        """
        n = len(text)
        if n <= 1:
            return [text] if n else []
        ranks, known, reach = self.ranks, self._fits, self._reach
        path: list = []
        settled: set[int] = set()
        at, size = 0, min(n, reach.get(text[:2], 1))
        while at < n:
            token = text[at : at + size]
            if (size == 1 or token in ranks) and at + size not in settled:
                if path:
                    near = known.get((path[-1], token))
                    if near is None:
                        near = self.fits(path[-1], token)
                else:
                    near = self.stands(token)
                if near:
                    path.append(token)
                    at += size
                    size = min(n - at, reach.get(text[at : at + 2], 1))
                    continue
            size -= 1
            while not size:
                settled.add(at)
                if not path:
                    return self.merge(text)
                size = len(path.pop())
                at -= size
                size -= 1
        return path


class Counter:
    """Deterministic transducer that reads symbols and emits on each transition how the number of tokens changes; compiled as it is used.

    A state holds, for every start from which a vocabulary entry may still go on, the symbols read since then, the token that ends
    there, and how many tokens fewer there are up to there. Texts that agree in these go on alike, whatever came before.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.open = {entry[:i] for entry in merges.ranks for i in range(1, len(entry))}
        self.start = ((next(iter(merges.ranks))[:0], None, 0),)

    def step(self, state: tuple, symbol) -> tuple[tuple, int]:
        """(next state, change of the token count)."""
        merges, ranks = self.merges, self.merges.ranks
        for read, before, behind in state:
            token = read + symbol
            if (len(token) == 1 or token in ranks) and (merges.stands(token) if before is None else merges.fits(before, token)):
                break
        else:
            raise ValueError("merges without a pairwise form")
        change = behind + 1
        alive = [(read + symbol, before, behind - change) for read, before, behind in state if read + symbol in self.open]
        return (*alive, (symbol[:0], token, 0)), change


def byte_level(path: str) -> tuple[Merges, dict[bytes, int], list[str]]:
    """Merges, ids by bytes and special strings of a byte-level tokenizer file (tokenizers' JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # printable stand-ins of the 256 bytes, as byte-level vocabularies write them
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}

    def raw(s: str) -> bytes:
        return bytes(stand_in[c] for c in s)

    specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
    ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in specials}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    pairs = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}
    ranks: dict[bytes, int] = {}
    for (a, b), rank in pairs.items():
        ranks.setdefault(a + b, rank)
    return Merges(ranks, pairs), ids, specials
