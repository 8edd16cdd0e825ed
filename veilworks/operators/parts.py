"""Long texts in parts: blocks of bytes, windows of tokens."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block.
BLOCK = 4096
#: Tokens of a window, tokens that two windows share where no sentence ends, windows of a text.
BODY, OVERLAP, MOST_WINDOWS = 254, 32, 128


def ends_of_blocks(content: bytes, size: int = BLOCK) -> list[int]:
    """Where blocks of up to `size` bytes end: after the last line end in each, but not one at its very start, else between characters."""
    ends, at = [], 0
    while at < len(content):
        end = min(len(content), at + size)
        if end < len(content):
            line = content.rfind(b"\n", at, end)
            if line > at:
                end = line + 1
            else:
                while end > at + 1 and content[end] & 0xC0 == 0x80:
                    end -= 1
        ends.append(end)
        at = end
    return ends


def _blocks(column: pa.Array) -> pa.Array:
    out = []
    for text in column.to_pylist():
        content = (text or "").encode()
        ends = ends_of_blocks(content)
        out.append([{"begin": a, "text": content[a:b].decode()} for a, b in zip([0, *ends], ends)])
    return pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("text", pa.string())])))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, at, begin, text): texts in blocks of up to BLOCK bytes, with where each begins in bytes (V10). Null and empty texts give nothing; together the blocks are the text."""
    cut = F.arrow_udf(_blocks, "array<struct<begin:int,text:string>>")(F.col("text"))
    return docs.select("doc_id", F.posexplode(cut).alias("at", "b")).select("doc_id", "at", "b.begin", "b.text")


def windows_of(tokens: int, cuts: list[int], body: int = BODY, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[first, end) of each window: up to the latest token in it that ends a sentence, else `body` tokens, the last `overlap` of which the next window sees too."""
    out, start = [], 0
    while start < tokens:
        limit = min(tokens, start + body)
        k = bisect_left(cuts, limit) - 1
        if limit == tokens:
            end = following = tokens
        elif k >= 0 and cuts[k] >= start:
            end = following = cuts[k] + 1
        else:
            end, following = limit, limit - overlap
        out.append((start, end))
        start = following
    return out


def _windows(tokens: pa.Array, cuts: pa.Array) -> pa.Array:
    rows = [[{"first": a, "end": b} for a, b in windows_of(n or 0, c or [])] for n, c in zip(tokens.to_pylist(), cuts.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))


def token_windows(docs: DataFrame, tokens: Column, cuts: Column) -> DataFrame:
    """(doc_id, at, first, end, overloaded) from how many tokens each text has, and after which of them (from 0, ascending) a sentence ends.

    A text of more than MOST_WINDOWS windows is overloaded, which all its windows say. Texts without tokens give nothing.
    """
    found = docs.select("doc_id", F.arrow_udf(_windows, "array<struct<first:int,end:int>>")(tokens.cast("int"), cuts.cast("array<int>")).alias("w"))
    return found.select("doc_id", F.posexplode("w").alias("at", "x"), (F.size("w") > MOST_WINDOWS).alias("overloaded")).select("doc_id", "at", "x.first", "x.end", "overloaded")


def words_and_cuts(text: Column) -> tuple[Column, Column]:
    """How many words a text has, and after which of them a sentence ends: those that end with a mark, or that a line end follows."""
    word = r"[^ \t\r\n]+"
    words, after = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.slice(F.split(text, word, -1), 2, 1 << 30)
    ending = F.zip_with(words, after, lambda w, gap: w.rlike("[.?!。]$") | gap.rlike(r"[\r\n]"))
    return F.regexp_count(text, F.lit(word)), F.filter(F.transform(ending, lambda yes, i: F.when(yes, i)), lambda i: i.isNotNull())
