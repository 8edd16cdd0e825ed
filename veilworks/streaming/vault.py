"""Vault scopes (T3) on a stream of what is done to them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilworks.operators.ledger import vault

OUT = "scope string, id long, ts timestamp, action string, value string, verdict string"


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    until, values = state.get if state.exists else (0.0, [])
    held, rows = {"live": state.exists, "until": until, "values": list(values)}, pd.concat(list(batches)).sort_values(["ts", "id"])
    yield rows.assign(verdict=[vault(held, r) for r in rows.to_dict("records")])[["scope", "id", "ts", "action", "value", "verdict"]]
    if held["live"]:
        state.update((held["until"], held["values"]))
        # A scope that nobody touches goes when the watermark passes its end.
        state.setTimeoutTimestamp(max(int(held["until"] * 1000), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def scopes(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of events (scope, id, ts, action, value, seconds) with verdict; those of a scope within a batch go by time. Only live scopes have state."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy("scope").applyInPandasWithState(_judge, OUT, "until double, vals array<string>", "append", GroupStateTimeout.EventTimeTimeout)
