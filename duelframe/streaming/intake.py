"""Arriving observations of matches: the first record of a match is kept by digest, later ones are told same or conflicting as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that these processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "match_id string, batch_id string, observer_tag long, action string"
DAY_MS = 24 * 3600 * 1000


class FirstRecord(StatefulProcessor):
    """Per match: digest and batch of its first readable record, forgotten ``days`` after they were last written.

    Unlike dropping duplicates, a record with another digest is not lost: it comes out as a conflict.
    """

    def __init__(self, days: float = 35.0):
        self.ttl_ms = int(days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string, batch_id string", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        digest = initialState["payload_hash"].iloc[0]
        if pd.notna(digest):
            self.first.update((digest, None))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.first.get()[0] if self.first.exists() else None
        new = pd.concat(list(rows)).sort_values(["batch_id", "observer_tag"])
        actions = []
        for digest, batch in zip(new["payload_hash"], new["batch_id"]):
            if pd.isna(digest):
                actions.append("conflict")
            elif held is None:
                held = digest
                self.first.update((digest, batch))
                actions.append("insert")
            else:
                actions.append("same" if digest == held else "conflict")
        yield pd.DataFrame({"match_id": key[0], "batch_id": new["batch_id"], "observer_tag": new["observer_tag"], "action": actions})

    def close(self) -> None:
        pass


def import_actions(observations: DataFrame, known: DataFrame | None = None, days: float = 35.0) -> DataFrame:
    """(match_id, batch_id, observer_tag, action) of a stream of (match_id, batch_id, observer_tag, payload_hash), with ``known`` matches (match_id, payload_hash) as what was seen before.

    Equal to ``operators.intake.import_actions`` where batches arrive in their order; a null digest is an unreadable record and conflicts. A match that is silent for
    ``days`` is new again. The session's state store has to be ``PROVIDER``.
    """
    start = None if known is None else known.groupBy("match_id")
    return observations.groupBy("match_id").transformWithStateInPandas(FirstRecord(days), SCHEMA, "append", "ProcessingTime", start)
