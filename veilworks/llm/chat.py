"""Chat formatting: the cheapest repair of each conversation's roles to a legal sequence of turns, rendered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, cut, small_batches, table

ROLES = ("system", "user", "assistant")
#: States are the roles of the last turn so far, and the start; which role may follow which.
START = len(ROLES)
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
#: What a repair costs. A turn whose role isn't one of ROLES must be relabelled.
MERGE, RELABEL, INSERT = 1, 2, 3
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n"
FAR = 1 << 40


@dataclass(frozen=True)
class Move:
    """What is done with a turn: the role it gets, the role of an empty turn put before it, whether it joins the last turn, and the price."""

    role: int
    insert: int | None
    merge: bool
    cost: int

    @property
    def name(self) -> str:
        return ("insert+" if self.insert is not None else "") + ("merge" if self.merge else "keep")


def _moves(state: int, given: int | None) -> list[Move]:
    """All that can be done with a turn of the given role after `state`, in the order in which ties are settled."""
    found = []
    for role in sorted(range(len(ROLES)), key=lambda r: r != given):
        label = 0 if role == given else RELABEL
        if role in FOLLOWS[state]:
            found.append(Move(role, None, False, label))
        if role == state:
            found.append(Move(role, None, True, label + MERGE))
        found += [Move(role, x, False, label + INSERT) for x in FOLLOWS[state] if role in FOLLOWS[x]]
    return found


STATES = range(len(ROLES) + 1)
GIVEN: dict[str | None, int | None] = {r: i for i, r in enumerate(ROLES)}
MOVES = {(s, g): _moves(s, g) for s in STATES for g in (None, *range(len(ROLES)))}


def costs_to_go(roles: list[int | None], end: list[int]) -> list[list[int]]:
    """For each turn, and the end, the least cost from each state on."""
    out = [end]
    for given in reversed(roles):
        after = out[-1]
        out.append([min(m.cost + after[m.role] for m in MOVES[s, given]) for s in STATES])
    return out[::-1]


def repaired(roles: list[int | None], start: int, end: list[int]) -> list[Move]:
    """The cheapest moves from a state on; of equally cheap ones the first in the order of _moves, earlier turns first."""
    togo, state, out = costs_to_go(roles, end), start, []
    for i, given in enumerate(roles):
        move = min(MOVES[state, given], key=lambda m: m.cost + togo[i + 1][m.role])
        out.append(move)
        state = move.role
    return out


def transfer(roles: list[int | None]) -> list[int]:
    """The least cost between every two states over a run of turns, by rows."""
    columns = [costs_to_go(roles, [0 if s == t else FAR for s in STATES])[0] for t in STATES]
    return [min(columns[t][s], FAR) for s in STATES for t in STATES]


def turns_begun(moves: list[Move]) -> int:
    return sum((not m.merge) + (m.insert is not None) for m in moves)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Rows of one conversation after the other, as lists of column values."""
    held: list[list] = []
    for batch in arrow_rows(batches, 4096):
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if held and held[0][1] != row[1]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _given(run: list[list]) -> list[int | None]:
    return [GIVEN.get(row[3]) for row in run]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], bool]]:
    """The runs of a partition, and whether each is its first or last."""
    runs, last = _runs(batches), None
    for n, run in enumerate(runs):
        if last:
            yield last, n == 1
        last = run
    if last:
        yield last, True


def _transfers(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _edges(batches):
            if edge:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([repr(rows[0][1])]), pa.array([transfer(_given(rows))], pa.list_(pa.int64()))], ["part", "conv", "costs"])

    return run


def _ways(ends: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _edges(batches):
            if edge and (at := (rows[0][0], repr(rows[0][1]))) in ends:
                ways = [repaired(_given(rows), s, ends[at]) for s in STATES]
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]]), pa.array([[w[-1].role for w in ways]], pa.list_(pa.int64())), pa.array([[turns_begun(w) for w in ways]], pa.list_(pa.int64()))], ["part", "conv", "states", "turns"])

    return run


def _rendered(ends: dict, starts: dict, more: set, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows, _ in _edges(batches):
            at = (rows[0][0], repr(rows[0][1]))
            state, begun = starts.get(at, (START, 0))
            moves = repaired(_given(rows), state, ends.get(at, [0] * len(STATES)))
            for i, (row, move) in enumerate(zip(rows, moves)):
                head = JOIN if move.merge else (CLOSE if begun else "")
                if move.insert is not None:
                    head += OPEN.format(ROLES[move.insert]) + CLOSE
                head += "" if move.merge else OPEN.format(ROLES[move.role])
                begun += turns_begun([move])
                tail = CLOSE if i + 1 == len(rows) and at not in more else ""
                action = move.name + ("+relabel" if GIVEN.get(row[3]) != move.role else "")
                out.append((*row[1:], ROLES[move.role], action, begun - 1, head + (row[4] or "").replace("<|", "< |") + tail))
                if len(out) >= 2048:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repair(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, new_role, action, out_turn, fragment) for each row of df.

    A legal conversation has at most one system turn, first, then user and assistant turns in
    alternation, the user's first. Turns are merged with the one before, relabelled, or preceded by
    an empty turn, at the least total price. out_turn numbers the turn that a row ends up in; a
    conversation's fragments, in order, are its rendering, in which `<|` within a text is spaced
    apart. Turns go by their number, then role, then text, nulls first; repeated rows are turns of
    their own; null keys form a conversation; null texts are empty; an empty table stays empty.

    Rows are range-partitioned by conversation and turn, so that a conversation of any length is
    spread. Where one spans partitions, its parts' costs between states (a small matrix each, two a
    partition at most) are combined on the driver, and the parts are then repaired on their own.
    """
    spark = df.sparkSession
    rows = small_batches(df).select(F.col(key).alias("k"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    order = [F.col("k"), F.col("t"), F.col("r"), F.xxhash64("x"), F.rand(8)]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions("k", "t", "r", F.xxhash64("x")).select(F.spark_partition_id().alias("part"), "k", "t", "r", "x"))
    edges = dealt.mapInArrow(_transfers(key), "part int, conv string, costs array<bigint>").collect()
    parts: dict[str, list] = {}
    for row in sorted(edges, key=lambda r: r["part"]):
        parts.setdefault(row["conv"], []).append(row)
    spread = {conv: own for conv, own in parts.items() if len(own) > 1}
    ends: dict[tuple, list[int]] = {}
    for conv, own in spread.items():
        end = [0] * len(STATES)
        for row in reversed(own):
            ends[row["part"], conv] = end
            costs = np.array(row["costs"]).reshape(len(STATES), len(STATES))
            end = (costs + np.array(end)).min(axis=1).tolist()
    starts: dict[tuple, tuple[int, int]] = {}
    more: set[tuple] = set()
    if spread:
        ways = {(r["part"], r["conv"]): r for r in dealt.mapInArrow(_ways(ends), "part int, conv string, states array<bigint>, turns array<bigint>").collect()}
        for conv, own in spread.items():
            state, begun = START, 0
            for row in own:
                at = (row["part"], conv)
                starts[at] = (state, begun)
                state, begun = ways[at]["states"][state], begun + ways[at]["turns"][state]
            more |= {(row["part"], conv) for row in own[:-1]}
    kinds = [f"{c} {t}" for c, t in rows.dtypes]
    fields = ", ".join([*kinds, "new_role string", "action string", "out_turn bigint", "fragment string"])
    shape = pa.schema([pa.field(f.name, t) for f, t in zip(rows.schema, _arrow_types(rows))] + [("new_role", pa.string()), ("action", pa.string()), ("out_turn", pa.int64()), ("fragment", pa.string())])
    done = dealt.mapInArrow(_rendered(ends, starts, more, shape), fields)
    return done.select(F.col("k").alias(key), F.col("t").alias(turn), F.col("r").alias(role), F.col("x").alias(text), "new_role", "action", "out_turn", "fragment")


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    return [f.type for f in df.limit(0).toArrow().schema]


def joined(fragments: DataFrame, *, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, rendered) for conversations that fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("out_turn", turn, "role", F.xxhash64("text"), "fragment")))
    return fragments.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("rendered"))


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
