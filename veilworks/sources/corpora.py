"""Labelled corpora in JSON, and audit lines as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAMAGED = "_damaged"


def entries(files: DataFrame, shape: str, items: str) -> DataFrame:
    """(path, at, item) of files (path, content), JSON objects whose field `items` is a list (S23): an item a row, numbered from 1.

    shape: the schema of an object. A file that isn't JSON of this shape, or whose list is null, gives one row with a null
    item, so that damaged(...) counts it; an empty list gives none.
    """
    read = F.from_json("content", f"{shape}, {DAMAGED} string", {"columnNameOfCorruptRecord": DAMAGED, "mode": "PERMISSIVE"})
    rows = files.select("path", read.alias("r"))
    whole = F.when(F.col(f"r.{DAMAGED}").isNull(), F.col(f"r.{items}"))
    return rows.select("path", F.posexplode(F.coalesce(whole, F.array(F.lit(None)))).alias("at", "item")).select("path", (F.col("at") + 1).alias("at"), "item")


def damaged(found: DataFrame, group: Column) -> DataFrame:
    """(group, n_items, n_damaged) of entries()."""
    return found.groupBy(group.alias("group")).agg(F.count_if(F.col("item").isNotNull()).alias("n_items"), F.count_if(F.col("item").isNull()).alias("n_damaged"))


def append_lines(lines: DataFrame, folder: str) -> None:
    """Appends chained audit lines to a folder of JSON lines, a subfolder a chain (K4). Files that are there are left as they are."""
    lines.withColumn("day", F.col("chain")).repartition("day").sortWithinPartitions("chain", "seq").write.mode("append").partitionBy("day").json(folder)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Audit lines of a folder that append_lines() wrote."""
    return spark.read.schema("chain string, seq bigint, kind string, fields string, prev string, hash string, day string").json(folder).drop("day")
