"""Audit lines: hash chain, checkpoints, verification; and the sweeps over events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.operators.running import running

GENESIS = "0" * 64
IN_FLIGHT = 16


def canonical(kind: Column, fields: Column, prev: Column) -> Column:
    """The text whose digest is a line's hash."""
    return F.concat_ws("|", prev, kind, fields)


def chained(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """lines (chain, seq, kind, fields, ...) with prev and hash (T4): each line's hash covers the hash before it, so a chain is one task's work and chains are spread.

    A chain is read in order, batch by batch, and only its last hash is kept. heads (chain, last_hash),
    a row a chain, say where earlier lines of a chain ended; without one it begins at GENESIS. Lines
    of a null chain are a chain; columns of lines besides those four go along.
    """
    begun = lines.withColumn("__head", F.lit(None).cast("string")) if heads is None else lines.join(heads.select(F.col("chain").alias("__chain"), F.col("last_hash").alias("__head")), F.col("chain").eqNullSafe(F.col("__chain")), "left").drop("__chain")
    ordered = begun.repartition("chain").sortWithinPartitions("chain", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = object(), GENESIS
        for rows in batches:
            prevs, hashes = [], []
            for c, kind, fields, head in zip(rows["chain"], rows["kind"], rows["fields"], rows["__head"]):
                if c != chain:
                    chain, last = c, head or GENESIS
                prevs.append(last)
                last = hashlib.sha256(f"{last}|{kind}|{fields}".encode()).hexdigest()
                hashes.append(last)
            yield rows.drop(columns="__head").assign(prev=prevs, hash=hashes)

    return ordered.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in lines.dtypes) + ", prev string, hash string")


def verified(lines: DataFrame) -> DataFrame:
    """(chain, n_lines, verdict) of chained lines (T7): `corrupt` where a hash isn't its line's, `broken` where a line doesn't name the hash before it, else `ok`. Lines are checked in parallel."""
    w = Window.partitionBy("chain").orderBy("seq")
    each = lines.select("chain", (F.sha2(canonical(F.col("kind"), F.col("fields"), F.col("prev")), 256) != F.col("hash")).alias("corrupt"), (F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))).alias("broken"))
    verdict = F.when(F.bool_or("corrupt"), "corrupt").when(F.bool_or("broken"), "broken").otherwise("ok")
    return each.groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"), verdict.alias("verdict"))


def checkpoints(lines: DataFrame) -> DataFrame:
    """(chain, n_lines, last_hash) (T5)."""
    return lines.groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"), F.max_by("hash", "seq").alias("last_hash"))


def segments(lines: DataFrame) -> DataFrame:
    """(chain, segment, n_lines, first_seq, opened_with, last_hash) of chained lines with a segment each, such as the day (T5): what each segment of a chain begins with and ends in, so that segments can be checked one by one and against one another."""
    return lines.groupBy("chain", "segment").agg(F.count(F.lit(1)).alias("n_lines"), F.min("seq").alias("first_seq"), F.min_by("prev", "seq").alias("opened_with"), F.max_by("hash", "seq").alias("last_hash"))


def in_flight(starts: DataFrame, seconds: int, limit: int = IN_FLIGHT) -> DataFrame:
    """(key, id, ts, running, overloaded): how many requests of a key run when each begins, if each takes `seconds` (T8, T12). Ends come before starts of the same instant. A key of any size is swept by many tasks."""
    moves = starts.select("key", "id", "ts", F.lit(1).alias("move")).unionByName(starts.select("key", "id", (F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("ts"), F.lit(-1).alias("move")))
    return running(moves, ["key"], ["ts", "move", "id"], "move").where("move = 1").select("key", "id", "ts", "running", (F.col("running") > limit).alias("overloaded"))


def expired(checkpoint: DataFrame, today: str, days: int = 365) -> DataFrame:
    """checkpoint (chain as a day) with whether the day is over its retention."""
    return checkpoint.withColumn("expired", F.datediff(F.lit(today).cast("date"), F.to_date("chain")) > days)
