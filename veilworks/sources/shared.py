"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir where it is set; in local mode (tests) a folder of our own where it isn't."""
    context = spark.sparkContext
    held = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if held or not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='veilworks-')}")


def cut(df: DataFrame) -> DataFrame:
    """A narrow table that is used more than once, computed once and kept in the shared folder: a lost executor costs no second scan of the texts."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The path of the shared folder."""
    ensure_shared_dir(spark)
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (held or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")
