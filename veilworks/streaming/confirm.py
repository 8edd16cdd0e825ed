"""The confirmation ledger (T1) on a stream: a map of tokens for each gate, with timers that clear what nobody redeems."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from veilworks.operators.ledger import CAPACITY, LIFETIME, Entry, gate_step

OUT = "gate string, id long, ts timestamp, action string, token string, verdict string"
ENTRY = "origin string, body string, until double, approved boolean"


class _Ledger(StatefulProcessor):
    def __init__(self, capacity: int, lifetime: float):
        self.capacity, self.lifetime = capacity, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getMapState("entries", "token string", ENTRY)

    def _held(self) -> dict[str, Entry]:
        """A gate's entries; there are `capacity` at most."""
        return {k[0]: Entry(*v) for k, v in self.entries.iterator()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = dict(held)
        events = pd.concat(list(rows)).sort_values(["ts", "id"])
        said = [gate_step(held, *row, self.capacity, self.lifetime) for row in zip(events["now"], events["action"], events["token"], events["body"], events["origin"])]
        for token in before.keys() - held.keys():
            self.entries.removeKey((token,))
        for token, entry in held.items():
            if before.get(token) != entry:
                self.entries.updateValue((token,), tuple(entry))
                if token not in before or before[token].until != entry.until:
                    self.handle.registerTimer(int(entry.until * 1000) + 1)
        yield events.assign(verdict=said)[["gate", "id", "ts", "action", "token", "verdict"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for token, entry in self._held().items():
            if entry.until <= due:
                self.entries.removeKey((token,))
        return iter(())

    def close(self) -> None:
        pass


def confirmations(events: DataFrame, capacity: int = CAPACITY, lifetime: float = LIFETIME, late: str = "1 minute", live: bool = False) -> DataFrame:
    """A stream of events (gate, id, ts, action, token, body, origin) with verdict, as ledger.gates() gives in batch; those of a gate within a batch go by time.

    Entries that nobody redeems are cleared by timers: when the watermark, `late` behind the latest
    event, passes their end; with live, for streams whose ts is the time of day, when the clock does.
    Events older than the watermark are dropped by Spark. The session's state store must be RocksDB's.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("now", F.unix_micros("ts") / 1e6)  # seconds do not depend on the session's time zone
    kept = timed if live else timed.withWatermark("ts", late)
    return kept.groupBy("gate").transformWithStateInPandas(statefulProcessor=_Ledger(capacity, lifetime), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if live else "EventTime")
