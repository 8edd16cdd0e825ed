"""State machines over keyed events, in batch: rows are sorted by key and time, and a task keeps one key's state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

LOCK_AFTER, LOCK_SECONDS = 5, 60
LIFETIME = 300


def folded(events: DataFrame, key: str, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], str], out: str) -> DataFrame:
    """events with `out`: what step says of each row, given its key's state. Keys are spread over tasks; a key is read in order, batch by batch."""
    ordered = events.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), begin()
        for rows in batches:
            said = []
            for row in rows.to_dict("records"):
                if row[key] != at:
                    at, state = row[key], begin()
                said.append(step(state, row))
            yield rows.assign(**{out: said})

    fields = ", ".join(f"{c} {t}" for c, t in events.dtypes)
    return ordered.mapInPandas(run, f"{fields}, {out} string")


def attempt(state: dict, row: dict) -> str:
    """After LOCK_AFTER failures in a row a client is locked for LOCK_SECONDS, and its count begins anew; a success clears it."""
    now = row["ts"].timestamp()
    if now < state["until"]:
        return "locked"
    if row["ok"]:
        state["failed"] = 0
        return "accepted"
    state["failed"] += 1
    if state["failed"] >= LOCK_AFTER:
        state.update(failed=0, until=now + LOCK_SECONDS)
    return "refused"


def lockouts(attempts: DataFrame) -> DataFrame:
    """attempts (client, id, ts, ok) with verdict."""
    return folded(attempts, "client", ["ts", "id"], lambda: {"failed": 0, "until": 0.0}, attempt, "verdict")


def confirm(state: dict, row: dict) -> str:
    """A token is bound to a body and an origin and used once. Another origin is refused and leaves it; another body, or too late, is refused and uses it up."""
    now = row["ts"].timestamp()
    if row["action"] == "issue":
        state.update(origin=row["origin"], body=row["body"], until=now + LIFETIME, approved=False, live=True)
        return "issued"
    if not state.get("live") or row["origin"] != state["origin"]:
        return "refused"
    if row["body"] != state["body"] or now > state["until"]:
        state["live"] = False
        return "refused"
    if row["action"] == "approve":
        state["approved"] = True
        return "approved"
    state["live"] = False
    return "accepted" if state["approved"] else "refused"


def confirmations(events: DataFrame) -> DataFrame:
    """events (token, id, ts, action: issue, approve or redeem, origin, body) with verdict."""
    return folded(events, "token", ["ts", "id"], dict, confirm, "verdict")


#: Fixed value: entries that a gate's ledger may hold.
CAPACITY = 1024


class Entry(NamedTuple):
    """What a token was issued for."""

    origin: str
    body: str
    until: float
    approved: bool


def gate_step(held: dict[str, Entry], now: float, action: str, token: str | None, body: str | None, origin: str | None, capacity: int = CAPACITY, lifetime: float = LIFETIME) -> str:
    """What a gate's ledger says to an event, and does to its entries.

    issue purges what is over and is `full` if `capacity` are left, else the token stands for its body
    and origin for `lifetime` seconds. approve needs the token's origin, in time, once. redeem with
    another origin is refused and leaves the entry; else it uses it up, and is accepted for the same
    body in time. claim needs no token: it uses up the approved entry of its body and origin, the
    least token of several.
    """
    entry = held.get(token)
    if action == "issue":
        for t in [t for t, e in held.items() if e.until <= now]:
            del held[t]
        if len(held) >= capacity:
            return "full"
        held[token] = Entry(origin, body, now + lifetime, False)
        return "issued"
    if action == "claim":
        fit = min((t for t, e in held.items() if e.approved and e.until > now and e.origin == origin and e.body == body), default=None)
        if fit is None:
            return "refused"
        del held[fit]
        return "accepted"
    if entry is None or entry.origin != origin:
        return "refused"
    if action == "approve":
        if entry.until <= now or entry.approved:
            return "refused"
        held[token] = entry._replace(approved=True)
        return "approved"
    del held[token]
    return "accepted" if entry.until > now and entry.body == body else "refused"


def gates(events: DataFrame, capacity: int = CAPACITY, lifetime: float = LIFETIME) -> DataFrame:
    """events (gate, id, ts, action: issue, approve, redeem or claim, token, body, origin) with verdict (T1). A gate is a state machine, so one task's work, with `capacity` entries at most; gates are spread. A null action or token is refused like any unknown one."""

    def step(state: dict, row: dict) -> str:
        return gate_step(state, row["ts"].timestamp(), row["action"], row["token"], row["body"], row["origin"], capacity, lifetime)

    return folded(events, "gate", ["ts", "id"], dict, step, "verdict")


#: Values that a scope may hold.
MOST_VALUES = 512


def vault(state: dict, row: dict) -> str:
    """A scope lives for `seconds` after it was created and holds up to MOST_VALUES values. The first touch of one that is too old finds it expired and removes it; then it is as if it had never been."""
    now = row["ts"].timestamp()
    if state.get("live") and now >= state["until"]:
        state.update(live=False, values=[])
        if row["action"] != "create":
            return "expired"
    if row["action"] == "create":
        if state.get("live"):
            return "exists"
        state.update(live=True, until=now + row["seconds"], values=[])
        return "created"
    if not state.get("live"):
        return "not_found"
    if row["action"] == "drop":
        state.update(live=False, values=[])
        return "dropped"
    if row["action"] == "resolve":
        return "resolved" if row["value"] in state["values"] else "unknown"
    if row["value"] not in state["values"]:
        if len(state["values"]) >= MOST_VALUES:
            return "full"
        state["values"].append(row["value"])
    return "issued"


def scopes(events: DataFrame) -> DataFrame:
    """events (scope, id, ts, action: create, issue, resolve or drop, value, seconds) with verdict."""
    return folded(events, "scope", ["ts", "id"], dict, vault, "verdict")
