"""Samples by stratum, stability of verdicts, and made numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.functions import numbers


def stratified(rows: DataFrame, by: str, flag: Column, key: str, most_with: int, most_without: int, seed: str) -> DataFrame:
    """(by, key, flagged): of each stratum up to most_with rows that have the flag and most_without that don't, in an order drawn by seed (A15). The limits are the operator's purpose; Spark applies them before it shuffles."""
    each = rows.select(by, key, F.coalesce(flag, F.lit(False)).alias("flagged"), F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256).alias("__order"))
    place = F.row_number().over(Window.partitionBy(by, "flagged").orderBy("__order", key))
    top = each.withColumn("__r", place).where(F.col("__r") <= max(most_with, most_without))
    return top.where(F.col("__r") <= F.when(F.col("flagged"), most_with).otherwise(most_without)).select(by, key, "flagged")


def unstable(rows: DataFrame, case: str, verdict: str) -> DataFrame:
    """(case, n, verdicts, flips) (A28): whether runs of the same case came to different verdicts."""
    n = F.count_distinct(verdict)
    return rows.groupBy(case).agg(F.count(F.lit(1)).alias("n"), n.alias("verdicts"), (n > 1).alias("flips"))


def made_business_number(nine: Column) -> Column:
    """Nine digits and the check digit that makes them a valid number."""
    total = numbers.weighted(nine, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(numbers.digit(nine, 9) * 5 / 10).cast("int")
    return F.concat(nine, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))
