"""A training corpus from raw documents: five stages, each working on what the one before kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from veilworks.llm import bpe, langid, minhash, mixing, toxicity
from veilworks.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold, judged by a model of all labelled ones."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice."""
    return mixing.mix(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.encode(docs, decoded="bytes"), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("language ID", keep_language), ("MinHash near-dedup", drop_copies), ("mixing", mix_sources), ("byte-level BPE", tokenize)]
#: SQL can express neither the trained stages nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, table(spark, sf_dir, "documents"))
