"""Lockout (T2) on a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilworks.operators.ledger import attempt

OUT = "client string, id long, ts timestamp, ok boolean, verdict string"


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failed, until = state.get if state.exists else (0, 0.0)
    held, rows = {"failed": failed, "until": until}, pd.concat(list(batches)).sort_values(["ts", "id"])
    yield rows.assign(verdict=[attempt(held, r) for r in rows.to_dict("records")])[["client", "id", "ts", "ok", "verdict"]]
    if held["failed"] or held["until"]:
        state.update((held["failed"], held["until"]))
    elif state.exists:
        state.remove()


def lockouts(attempts: DataFrame) -> DataFrame:
    """A stream of attempts (client string, id, ts, ok) with verdict; attempts of a client within a batch go by time. A client without failures or a lock has no state."""
    return attempts.groupBy("client").applyInPandasWithState(_judge, OUT, "failed int, until double", "append", GroupStateTimeout.NoTimeout)
