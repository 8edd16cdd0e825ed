"""Detectors that need an institution's own rules, or words nearby."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators.detect import matches

SLOTS = {"#": "[0-9]", "@": "[A-Za-z]", "*": "[A-Za-z0-9]"}
MOST_MASKS, LONGEST_MASK, LEAST_SLOTS = 16, 40, 4
#: Code points between a number and a word that explains it.
NEAR = 40
#: Code points of a bin of the band join.
BIN = 256


def mask_pattern(mask: str) -> str:
    """The pattern of a mask (D26): # a digit, @ a letter, * either, all else itself in any case. Refuses masks that are too long or say too little."""
    slots = sum(c in SLOTS for c in mask)
    if len(mask) > LONGEST_MASK or slots < LEAST_SLOTS or slots == len(mask):
        raise ValueError(f"mask {mask!r} needs {LEAST_SLOTS} slots, a literal, and at most {LONGEST_MASK} characters")
    return "".join(SLOTS.get(c) or (f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)) for c in mask)


def masked(mask: str) -> str:
    """What matches() looks for."""
    return rf"(?:^|[^A-Za-z0-9_])({mask_pattern(mask)})"


def unmasked(found: DataFrame) -> DataFrame:
    """find_masks() from matches of masked()."""
    return found.where(~F.col("next").rlike("^[A-Za-z0-9_]")).select("doc_id", "cs", "ce", F.lit("INSTITUTION_ID").alias("type"), F.lit("Mask").alias("detector"), "value")


def find_masks(docs: DataFrame, masks: list[str]) -> DataFrame:
    """Spans of an institution's identifiers (D26), not beside another letter, digit or low line."""
    if len(masks) > MOST_MASKS:
        raise ValueError(f"more than {MOST_MASKS} masks")
    return unmasked(matches(docs, {m: masked(m) for m in masks}))


def near(spans: DataFrame, words: DataFrame, reach: int = NEAR, same: tuple[str, ...] = ()) -> DataFrame:
    """spans (doc_id, cs, ce, ...) that stand within `reach` code points of one of words (doc_id, cs, ce), each once (J3), and share the columns `same` with it.

    Both are dealt to bins of BIN code points, so a long text full of numbers and words isn't paired
    all with all.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    w = words.select("doc_id", *same, (F.col("cs") - reach).alias("__from"), (F.col("ce") + reach).alias("__to"))
    w = w.withColumn("__bin", bins(F.col("__from"), F.col("__to")))
    s = spans.withColumn("__bin", bins(F.col("cs"), F.col("ce")))
    met = s.join(w, (s["doc_id"] == w["doc_id"]) & (s["__bin"] == w["__bin"]) & reduce(and_, [s[c] == w[c] for c in same], F.lit(True)) & (F.col("__from") <= F.col("ce")) & (F.col("cs") <= F.col("__to")), "left_semi")
    return met.drop("__bin").distinct()
