"""An audit log that a stream appends to (T4, T5, K4): hash chains that go on over batches and restarts, in a segment a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilworks.operators.audit import chained
from veilworks.sources.shared import cut

LINE = "chain string, seq long, kind string, fields string, segment string, prev string, hash string"
HEAD = "chain string, n_lines long, last_seq long, last_hash string"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def heads(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """(chain, n_lines, last_seq, last_hash) of all chains after a batch; none before the first."""
    if batch < 0:
        return spark.createDataFrame([], HEAD)
    path = f"{folder}/heads/batch={batch}"
    if not _exists(spark, path):
        raise ValueError(f"{path} is missing: the chains can't be continued")
    return spark.read.schema(HEAD).parquet(path)


def append(lines: DataFrame, batch: int, folder: str) -> None:
    """Adds a batch of lines (chain, seq, ts, kind, fields) to the log, once: a batch whose heads stand there is left alone, and one that was cut short is written again over itself.

    Each chain goes on from the hash and number that its last line has after the batch before. Lines
    are JSON, in a folder for each batch and, within it, each day of ts; a day's first line names the
    last hash of the day before, so a chain is unbroken over segments. Lines of a chain that aren't
    after its last one are an error.
    """
    spark = lines.sparkSession
    if _exists(spark, f"{folder}/heads/batch={batch}"):
        return
    before = heads(spark, folder, batch - 1)
    new = lines.select(F.col("chain").cast("string"), F.col("seq").cast("long"), F.col("kind").cast("string"), F.col("fields").cast("string"), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")).alias("segment"))
    done = cut(chained(new, before))
    ends = done.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"), F.max("seq").alias("most"), F.max_by("hash", "seq").alias("hash"))
    both = cut(before.join(ends.withColumnRenamed("chain", "c"), F.col("chain").eqNullSafe(F.col("c")), "full"))
    stale = both.where("least <= last_seq").select("c").first()
    if stale is not None:
        raise ValueError(f"lines of chain {stale[0]} come before its last one")
    done.write.mode("overwrite").partitionBy("segment").json(f"{folder}/lines/batch={batch}")
    new_heads = both.select(F.coalesce("chain", "c").alias("chain"), (F.coalesce("n_lines", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_lines"), F.coalesce("most", "last_seq").alias("last_seq"), F.coalesce("hash", "last_hash").alias("last_hash"))
    new_heads.write.mode("overwrite").parquet(f"{folder}/heads/batch={batch}")


def sink(lines: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that appends a stream of lines to the log in folder. Its checkpoint lies in the folder too, so batches are numbered for this log alone."""
    return lines.writeStream.foreachBatch(lambda batch, number: append(batch, number, folder)).option("checkpointLocation", f"{folder}/stream")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a log, of whole batches only."""
    whole = spark.read.schema(LINE + ", batch int").json(f"{folder}/lines")
    ready = spark.read.schema(HEAD + ", batch int").parquet(f"{folder}/heads").select("batch").distinct()
    return whole.join(ready, "batch", "left_semi").drop("batch")
