"""Answers: active content, tokens and where they stand, restoration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.operators import links
from veilworks.operators.links import linked

TOKEN = links.TOKEN.pattern
ACTIVE = ("<script", "javascript:", "vbscript:")


def active(text: Column) -> Column:
    """Whether a text holds active content."""
    low = F.lower(text)
    return F.coalesce(low.contains(ACTIVE[0]) | low.contains(ACTIVE[1]) | low.contains(ACTIVE[2]), F.lit(False))


def tokens(answers: DataFrame) -> DataFrame:
    """(doc_id, at, token): the tokens of each answer in order."""
    return answers.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1))).alias("at", "token"))


def restored(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, text, code) from answers and mapping (doc_id, token, value): tokens replaced by their values in one pass.

    503 for active content, 500 for a token in a link, 502 for a token that the document's own mapping
    doesn't know; such answers keep their text.
    """
    pairs = mapping.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("values"))
    joined = answers.join(pairs, "doc_id", "left").withColumn("values", F.coalesce("values", F.map_from_entries(F.array().cast("array<struct<token:string,value:string>>"))))
    joined = joined.withColumn("__linked", linked(F.col("text")))
    found, gaps = F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1)), F.split("text", TOKEN, -1)
    unknown = F.exists(found, lambda t: F.element_at("values", t).isNull())
    code = F.when(active(F.col("text")), 503).when(F.col("__linked"), 500).when(unknown, 502)
    said = F.array_join(F.zip_with(gaps, F.transform(found, lambda t: F.element_at("values", t)), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    return joined.select("doc_id", F.when(code.isNull(), said).otherwise(F.col("text")).alias("text"), code.alias("code"))


def alive(mapping: DataFrame, answers: DataFrame, seconds: int) -> DataFrame:
    """mapping (doc_id, ..., issued) without what is `seconds` old or older when its document's answer (doc_id, asked) comes (R6), so that restored() gives 502 for it. Of several answers the last one's time counts; without a time nothing is alive."""
    asked = answers.groupBy("doc_id").agg(F.max("asked").alias("__asked"))
    fresh = F.col("__asked") < F.col("issued") + F.make_dt_interval(secs=F.lit(seconds))
    return mapping.join(asked, "doc_id").where(fresh & (F.col("__asked") >= F.col("issued"))).drop("__asked")
