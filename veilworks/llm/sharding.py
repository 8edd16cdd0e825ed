"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import let, number_rows, table, utf8_size

#: Modulus of the round function: a Mersenne prime, so that the product of two residues fits in a long.
PRIME = (1 << 31) - 1
ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    """a and b of a near-square a * b that holds n numbers, with fewer than a to spare."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int, rounds: int) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(rounds)]


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network, a permutation of [0, a * b): each round adds a keyed square of one side to the other."""
    a, b = sides(n)
    pair = F.struct(F.call_function("div", x, F.lit(b)).alias("left"), F.pmod(x, F.lit(b)).alias("right"))
    keys = F.array(*[F.struct(F.lit(k % 2).alias("odd"), F.lit(times).alias("times"), F.lit(plus).alias("plus")) for k, (times, plus) in enumerate(round_keys(seed, ROUNDS))])

    def mixed(p: Column, key: Column) -> Column:
        square = let(F.pmod(F.when(key.odd == 1, p.left).otherwise(p.right) * key.times + key.plus, F.lit(PRIME)), lambda t: F.pmod(t * t, F.lit(PRIME)))
        return F.when(key.odd == 1, F.struct(p.left.alias("left"), F.pmod(p.right + square, F.lit(b)).alias("right"))).otherwise(F.struct(F.pmod(p.left + square, F.lit(a)).alias("left"), p.right.alias("right")))

    return F.aggregate(keys, pair, mixed, lambda p: p.left * F.lit(b) + p.right)


def permuted(x: Column, n: int, seed: int) -> Column:
    """A permutation of [0, n), by cycle walking: numbers that fall outside go through the network again.

    A walk passes each of the a * b - n < a numbers outside once at most, so as many steps always do.
    For large n one number in about the root of n needs a second step, so 40 steps do; a row that
    still lay outside would raise an error, not be lost.
    """
    a, b = sides(n)
    steps = F.sequence(F.lit(1), F.lit(min(a * b - n, 40)))
    lost = F.raise_error(F.lit("the walk did not come back")).cast("long")
    again = lambda y: F.aggregate(steps, y, lambda z, _: F.when(z < n, z).otherwise(feistel(z, n, seed)), lambda z: F.when(z < n, z).otherwise(lost))
    return let(feistel(x, n, seed), lambda y: F.when(y < n, y).otherwise(again(y)) if a * b > n else y)


def shard(df: DataFrame, order_by: list[Column], shards: int, seed: int = 20) -> DataFrame:
    """df with columns row_number, shard and slot (both long): a reproducible shuffle.

    Rows are numbered from 0 in the given order and the numbers permuted; permuted number p lies in
    shard p mod shards at slot p div shards. So shard sizes are at most one row apart, slots have no
    gaps, and anyone can compute the place of row i from i, the count, the shard count and the seed.
    Equal texts are treated as any rows: a permutation spreads them. Nulls in the order come first;
    rows that tie get neighbouring numbers; an empty table stays empty. Columns of df named
    row_number, shard or slot are replaced.
    """
    numbered = number_rows(df.drop("row_number", "shard", "slot"), order_by, "row_number")
    n = numbered.count()
    placed = numbered.withColumn("__p", permuted(F.col("row_number"), n, seed))
    return placed.withColumns({"shard": F.pmod("__p", F.lit(shards)), "slot": F.call_function("div", F.col("__p"), F.lit(shards))}).drop("__p")


def place(row_number: int, n: int, shards: int, seed: int = 20) -> tuple[int, int]:
    """shard and slot of one row, as a reader computes them."""
    a, b = sides(n)
    x = row_number
    while True:
        pair = list(divmod(x, b))
        for k, (times, plus) in enumerate(round_keys(seed, ROUNDS)):
            of, into, m = (1, 0, a) if k % 2 == 0 else (0, 1, b)
            t = (pair[of] * times + plus) % PRIME
            pair[into] = (pair[into] + t * t % PRIME) % m
        x = pair[0] * b + pair[1]
        if x < n:
            return x % shards, x // shards


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`. A null text has size 1 and the checksum of no bytes."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = shard(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
