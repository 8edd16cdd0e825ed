"""What the operators of this package share: tables, shared files, row numbers, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x09-\x0D\x20]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's own; where neither is set, one of our own, in local mode (tests) only."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='veilworks-')}")
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """A narrow table, computed once and kept in the shared folder. Spark removes the files only if spark.cleaner.referenceTracking.cleanCheckpoints is set; else whoever owns the folder does."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A wide table, written as Parquet into the shared folder and read again. The files stay until whoever owns the folder removes them."""
    path = f"{shared_dir(df.sparkSession)}/veilworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id's decimal digits, modulo `of`: the folds of the labelled queries."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(of))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def number_rows(df: DataFrame, order_by: list[Column], name: str) -> DataFrame:
    """df with `name`, its rows' numbers from 0 in the given order.

    Rows are range-partitioned by the order, so no task holds more than its range; the partitions'
    counts give each its first number. The numbered table is kept in the shared folder: a lost
    executor can't make Spark draw other ranges. Rows that tie in the order get neighbouring numbers.
    """
    held = cut(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    first = first.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # One row a partition, whatever the table's size.
    return held.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session's Python functions get about 4 MB of rows at a time, so that long texts don't add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_length(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """The rows of a column in groups of about `size` bytes, the shortest texts first: their places, and the texts."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    order = np.argsort(sizes, kind="stable")
    group = (np.cumsum(sizes[order]) - sizes[order]) // size
    for places in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []:
        yield places, texts.take(pa.array(places)).to_pylist()
