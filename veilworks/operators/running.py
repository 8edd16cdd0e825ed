"""Running sums in groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilworks.sources.shared import cut


def running(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `running`, the sum of `value` over the rows of the same `by` up to their own place in `order`; null counts as 0.

    Rows are dealt to ranges of (by, order), so a group that holds a third of all rows is many tasks' work:
    each range sums its own part of a group, and the parts' totals, a row for each range and group in it,
    say what came before. Null is a group of its own; rows that tie in `order` are summed in any sequence.
    """
    ranged = cut(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))  # kept, since ranges drawn again may differ
    size = F.coalesce(F.col(value), F.lit(0))
    parts = ranged.groupBy(*by, "__range").agg(F.sum(size).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__range") == F.col("__of"))
    within = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__within", F.sum(size).over(within)).join(before, same)
    return summed.withColumn("running", F.col("__before") + F.col("__within")).select(*rows.columns, "running")
