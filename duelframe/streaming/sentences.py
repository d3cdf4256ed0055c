"""Answers that arrive piece by piece: whole sentences leave as soon as they are complete, and only those that their evidence supports are shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duelframe.functions import text as tx
from duelframe.operators import claims

# Fixed value: characters that end a sentence.
ENDS = "\n。！？!?"
SCHEMA = "answer_id long, evidence_id long, sentence int, body string"
#: State stores of this kind hold the open sentences.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(held: str, stop: tuple[str, ...], last: bool) -> tuple[list[str], str, bool]:
    """(whole sentences, what is held back, whether a stop marker was met) of the text so far."""
    at = min((p for m in stop if (p := held.find(m)) >= 0), default=-1)
    stopped = at >= 0
    held = held[:at] if stopped else held
    out, begin = [], 0
    for i, c in enumerate(held):
        if c in ENDS:
            out.append(held[begin : i + 1])
            begin = i + 1
    if (stopped or last) and begin < len(held):
        out.append(held[begin:])
        begin = len(held)
    return out, held[begin:], stopped


class OpenSentences(StatefulProcessor):
    """Per answer: the text after its last whole sentence, the number of the next one, and whether a stop marker was met.

    A timer that is set anew with every piece lets go what is held when an answer falls silent; ``last`` marks the piece that ends one.
    """

    def __init__(self, stop: tuple[str, ...] = tx.REFERENCE_MARKERS, idle_ms: int = 60_000):
        self.stop, self.idle_ms = stop, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "evidence_id long, held string, sentence int, stopped boolean")

    def _emit(self, key: tuple, evidence: int, parts: list[str], number: int) -> pd.DataFrame:
        return pd.DataFrame({"answer_id": key[0], "evidence_id": evidence, "sentence": range(number, number + len(parts)), "body": parts})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        evidence, held, number, stopped = self.state.get() if self.state.exists() else (None, "", 0, False)
        pieces = pd.concat(list(rows)).sort_values("seq")
        evidence, last = int(pieces["evidence_id"].iloc[0]) if evidence is None else evidence, bool(pieces["last"].any())
        parts: list[str] = []
        if not stopped:
            parts, held, stopped = cut(held + "".join(pieces["delta"].fillna("")), self.stop, last)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if last:
            self.state.clear()
        else:
            self.state.update((evidence, held, number + len(parts), stopped))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if parts:
            yield self._emit(key, evidence, parts, number)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            evidence, held, number, stopped = self.state.get()
            self.state.clear()
            if held and not stopped:
                yield self._emit(key, evidence, [held], number)

    def close(self) -> None:
        pass


def whole_sentences(pieces: DataFrame, stop: tuple[str, ...] = tx.REFERENCE_MARKERS, idle_ms: int = 60_000) -> DataFrame:
    """(answer_id, evidence_id, sentence, body) of a stream of (answer_id, evidence_id, seq, delta, last).

    Pieces of one answer are taken by ``seq`` within a micro-batch; what follows a stop marker is dropped. The session's state store has to be ``PROVIDER``. Timers fire in micro-batches, also in those
    without input unless spark.sql.streaming.noDataMicroBatches.enabled is off, as it has to be for a trigger that ends with the input.
    """
    return pieces.groupBy("answer_id").transformWithStateInPandas(OpenSentences(stop, idle_ms), SCHEMA, "append", "ProcessingTime")


def show_supported(evidence: DataFrame, each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: judges the sentences of a micro-batch by their evidence and hands (answer_id, sentence, body, supported) on."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            each(claims.judged(batch, evidence), number)
        finally:
            batch.unpersist()

    return run
