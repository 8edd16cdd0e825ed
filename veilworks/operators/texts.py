"""Texts as lines, sentences, segments and blocks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def identified(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the id and the text's hash together as doc_id, so that rows whose ids repeat or are null are told apart by what they say; equal rows stay equal. named() takes the id out again."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("said")))


def named(rows: DataFrame) -> DataFrame:
    """What follows from identified() rows, by their own ids again."""
    return rows.withColumn("doc_id", own_id(rows))


def own_id(rows: DataFrame) -> Column:
    """The id of each row, identified() or not."""
    return F.col("doc_id.id") if isinstance(rows.schema["doc_id"].dataType, StructType) else F.col("doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): the lines of a text that aren't blank, numbered from 1, one carriage return dropped from their ends."""
    each = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    said = F.regexp_replace("raw", "\r$", "")
    return each.select("doc_id", (F.col("at") + 1).alias("line"), said.alias("text")).where(F.trim("text") != "")


def pieces(docs: DataFrame, ends: str) -> DataFrame:
    """(doc_id, at, text): texts cut after each match of `ends` (a mark, then what follows), blank pieces dropped, numbered from 1."""
    marked = F.regexp_replace("text", ends, "$1\u0001")
    kept = F.filter(F.transform(F.split(marked, "\u0001", -1), lambda x: F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda x: x != "")
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(kept).alias("at", "text")).withColumn("at", F.col("at") + 1)


def rule_sentences(docs: DataFrame) -> DataFrame:
    """Sentences as the rules see them (V6): up to a line end, or a terminator before a blank or line end."""
    return pieces(docs, r"(\n|[.?!。…](?=[ \t\r\n]|$))")


def corpus_sentences(docs: DataFrame) -> DataFrame:
    """Sentences as the classifier sees them (V7): . ? ! or a line end, before a space, a line end or the end."""
    return pieces(docs, r"([.?!\n](?=[ \n]|$))")


#: What isn't text in a page: comments, scripts and styles to their ends, tags (one without an end takes all that follows), and references that are decoded.
MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|<script[^>]*(?:>.*?(?:</script[^>]*(?:>|\z)|\z)|\z)|<style[^>]*(?:>.*?(?:</style[^>]*(?:>|\z)|\z)|\z)|<[^>]*(?:>|\z)"
    r"|&(?-i:amp|lt|gt|quot|apos|nbsp|middot|hellip);|&#x[0-9a-f]{1,7};|&#[0-9]{1,8};"
)
#: Named references that are decoded; all others stay.
REFERENCES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("middot", "·"), ("hellip", "…"))


def _character(digits: Column, base: int, given: Column) -> Column:
    """The character of a number, or what was given where it is none."""
    n = F.conv(digits, base, 10).cast("long")
    made = F.when(n == 0xFEFF, "﻿").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))  # a leading mark of byte order isn't read as a character
    return F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), made).otherwise(given)


def _in_place(mark: Column) -> Column:
    """What stands in a line for one piece of markup."""
    tag, low = F.startswith(mark, F.lit("<")), F.lower(mark)
    cell = F.when(low.rlike(r"^<t[dh][> /\t\n\r]"), "| ").when(low.rlike(r"^</tr[> /\t\n\r]"), " |").otherwise("")
    broken = F.when(low.rlike("^<(?:br|/p|p|/div|/tr|/li|/h|h)"), "\n").otherwise("")
    named = F.element_at(F.create_map(*[F.lit(x) for name, c in REFERENCES for x in (f"&{name};", c)]), mark)
    digits = F.substring(low, F.lit(3), F.length(low) - 3)
    number = F.when(F.startswith(low, F.lit("&#x")), _character(F.substring(digits, F.lit(2), F.length(digits)), 16, mark)).otherwise(_character(digits, 10, mark))
    return F.when(tag, F.concat(cell, broken, F.when(low.rlike("^</t[dh]"), "\t").otherwise(""))).otherwise(F.when(F.startswith(mark, F.lit("&#")), number).otherwise(named))


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line, text): a page's lines (S11), blank ones dropped, numbered from 1.

    Comments, scripts and styles go; tags that begin like a block's break a line; cells begin with a bar
    and end with a tab; references are decoded once. Null gives nothing.
    """
    gaps, marks = F.split("html", MARKUP, -1), F.transform(F.regexp_extract_all("html", F.lit(MARKUP), F.lit(0)), _in_place)
    said = F.zip_with(gaps, marks, lambda gap, mark: F.concat(F.translate(gap, "\r", "\n"), F.coalesce(mark, F.lit(""))))
    kept = F.filter(F.transform(F.split(F.array_join(said, ""), "\n", -1), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")
    return pages.where(F.col("html").isNotNull()).select("page_id", F.posexplode(kept).alias("at", "text")).select("page_id", (F.col("at") + 1).alias("line"), "text")


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, role, text, begin, conv_bytes, code) of every turn (S4, S22): where each begins in bytes among its conversation's, and 202 where a conversation exceeds 64 KiB, 201 where it has no text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    of, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(size).over(of)
    return turns.select("conv_id", F.col("turn").alias("seg"), "role", "text", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("begin"), total.alias("conv_bytes"), F.when(total == 0, 201).when(total > 65536, 202).alias("code"))


def assembled(blocks: DataFrame) -> DataFrame:
    """(doc_id, text, n_blocks) from (doc_id, at, region, text): blocks joined by a line end, or by one, a bar and one where the region changes."""
    parts = F.sort_array(F.collect_list(F.struct("at", "region", "text")))
    joined = F.aggregate(
        F.col("parts"), F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("region")),
        lambda a, p: F.struct(F.when(a.region.isNull(), p.text).when(a.region == p.region, F.concat(a.out, F.lit("\n"), p.text)).otherwise(F.concat(a.out, F.lit("\n|\n"), p.text)).alias("out"), p.region.alias("region")),
        lambda a: a.out,
    )
    return blocks.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", joined.alias("text"), F.size("parts").alias("n_blocks"))


def paired(sentences: DataFrame, marker: Column, subject: Column) -> DataFrame:
    """(doc_id, at): sentences that hold a marker and a subject, or one of them beside a neighbour with the other (D28). Of such neighbours both are given."""
    w = Window.partitionBy("doc_id").orderBy("at")
    m, s = marker.alias("m"), subject.alias("s")
    flagged = sentences.select("doc_id", "at", m, s)
    near = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(False))
    flagged = flagged.withColumns({"m0": near("m", 1), "s0": near("s", 1), "m2": near("m", -1), "s2": near("s", -1)})
    return flagged.where((F.col("m") & (F.col("s") | F.col("s0") | F.col("s2"))) | (F.col("s") & (F.col("m0") | F.col("m2")))).select("doc_id", "at")


def valid(content: Column) -> Column:
    """Whether bytes are strict UTF-8 (V1): nothing overlong, no surrogate, nothing past the last code point."""
    return F.is_valid_utf8(content)


def _composed(column: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in column.to_pylist()], pa.string())


def comparable(text: Column) -> Column:
    """A text without zero-width marks and in composed form (V16). Only texts with other than ASCII characters reach Python; null stays null."""
    plain = F.regexp_replace(text, "[\u200b-\u200d\ufeff]", "")
    return F.coalesce(F.arrow_udf(_composed, "string")(F.when(plain.rlike(r"[^\x00-\x7F]"), plain)), plain)
