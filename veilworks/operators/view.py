"""The view of a text that detectors read: without invisible characters, and in compatibility form (V2)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are visible and their own compatibility form, wherever they stand: ASCII, Latin, Greek and Cyrillic letters, common marks, kana, ideographs and Hangul syllables.
SETTLED = (
    r"\t\n\r\x20-\x7E¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-žΑ-ωЀ-ҁҊ-ԯ"
    r"‐‒-‖‘-•‰‹›₠-₧€⟦⟧、。ぁ-ゖァ-ヺ一-鿿가-힣"
)
#: Controls but tab and line ends, noncharacters, and what Unicode lets a renderer ignore.
INVISIBLE = re.compile(
    "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸￾￿\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
VIEW = "struct<text:string,moved:array<struct<at:int,cs:int,ce:int>>>"


#: A run of other characters, with the settled one before it, which they may join.
_UNSETTLED = re.compile(f"[{SETTLED}]?[^{SETTLED}]+")
#: What stands for a text that can't be read with certainty; no view holds this character.
REFUSED = "\x00"


def _joins(c: str) -> bool:
    """Whether a character may compose with what stands before it: combining marks, and vowels and finals of Hangul, also as what a compatibility form holds."""
    if c < "\u0300":
        return False
    first = unicodedata.normalize("NFKD", c)[:1]
    return bool(unicodedata.combining(first)) or "\u1160" <= first <= "\u11ff"


def view(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The view of a text; and where it moves: (place in the view, start and end in the text) of each character that doesn't follow the one before by one step.

    Where the parts of a text have another compatibility form than the whole, no place in the view can be
    told for certain: the view is REFUSED, and the text is to be refused with it.
    """
    out, moved, expected, n, at = [], [], 0, 0, 0
    seen = []
    for run in _UNSETTLED.finditer(text + "\0"):  # the end, which is left out again
        first, last = run.start(), min(run.end(), len(text))
        if at < first:  # settled characters are their own form, and none of them joins
            if at != expected:
                moved.append((n, at, at + 1))
            out.append(text[at:first])
            seen.append(text[at:first])
            n, expected = n + first - at, first
        chars = [(i, text[i]) for i in range(first, last) if not INVISIBLE.match(text[i])]
        seen.append("".join(c for _, c in chars))
        k = 0
        while k < len(chars):
            m = k + 1
            while m < len(chars) and _joins(chars[m][1]):
                m += 1
            part = unicodedata.normalize("NFKC", "".join(c for _, c in chars[k:m]))
            begin, end = chars[k][0], chars[m - 1][0] + 1
            for _ in part:
                if begin != expected or end != begin + 1:
                    moved.append((n, begin, end))
                n, expected = n + 1, begin + 1 if end == begin + 1 else -1
            out.append(part)
            k = m
        at = last
    said = "".join(out)
    whole = unicodedata.normalize("NFKC", "".join(seen))
    return (said, moved) if said == whole else (REFUSED, [])


#: Rows that become Python's at a time.
ROWS = 64
_MOVE = pa.struct([("at", pa.int32()), ("cs", pa.int32()), ("ce", pa.int32())])


def _views(column: pa.Array) -> pa.Array:
    """The view of each text that needs one, else null; a few texts at a time, since their characters are objects while they are looked at."""
    kind = pa.struct([("text", pa.string()), ("moved", pa.list_(_MOVE))])
    try:
        column.validate(full=True)
        needed = np.asarray(pc.fill_null(pc.match_substring_regex(column, f"[^{SETTLED}]"), False))
    except pa.ArrowInvalid:  # bytes that are no UTF-8: as they are
        needed = np.zeros(len(column), bool)
    at = np.flatnonzero(needed)
    if not len(at):
        return pa.nulls(len(column), kind)
    parts = []
    for k in range(0, len(at), ROWS):
        said, sizes, moves = [], [0], []
        for i in at[k : k + ROWS]:
            text, moved = view(column[int(i)].as_py())
            said.append(text)
            moves.append(np.array(moved, np.int32).reshape(-1, 3))
            sizes.append(sizes[-1] + len(moved))
        places = np.concatenate(moves)
        move = pa.StructArray.from_arrays([pa.array(places[:, j]) for j in range(3)], fields=list(_MOVE))
        parts.append(pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), move)], fields=list(kind)))
    number = np.full(len(column), -1, np.int64)
    number[at] = np.arange(len(at))
    return pa.concat_arrays(parts).take(pa.array(number, mask=number < 0))


def viewed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `text` its view, and `moved`, null where the view is the text. Texts with none but settled characters are told by columns and stay as they are; a null text stays null, and one that must be refused is REFUSED."""
    # Nondeterministic to the optimizer, which would else look at a text once more for each filter of its view.
    seen = docs.select("doc_id", "text").withColumn("__v", F.arrow_udf(_views, VIEW).asNondeterministic()(F.col("text")))
    return seen.select("doc_id", F.coalesce("__v.text", "text").alias("text"), F.when(F.col("__v.text") != F.col("text"), F.col("__v.moved")).alias("moved"))


def back(spans: DataFrame, moved: DataFrame) -> DataFrame:
    """Spans of views as spans of the texts (V14): from the first character's source to the last one's. moved (doc_id, moved): the few texts that differ from their views."""
    at = lambda k: F.try_element_at(F.filter("moved", lambda m: m.at <= k), F.lit(-1))
    own = spans.join(moved, "doc_id", "left").withColumns({"__a": at(F.col("cs")), "__b": at(F.col("ce") - 1)})
    # A jump holds for its own character; those after it follow by one step each.
    cs = F.when(F.col("__a").isNull(), F.col("cs")).otherwise(F.col("__a.cs") + F.col("cs") - F.col("__a.at"))
    ce = F.when(F.col("__b").isNull(), F.col("ce")).when(F.col("__b.at") == F.col("ce") - 1, F.col("__b.ce")).otherwise(F.col("__b.cs") + F.col("ce") - F.col("__b.at"))
    return own.select(*[{"cs": cs.alias("cs"), "ce": ce.alias("ce")}.get(c, F.col(c)) for c in spans.columns])
