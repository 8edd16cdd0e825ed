"""Secrets without a shape (D22): values near a word that announces one, whose letters follow one another as they hardly ever do in the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators.detect import matches

#: Classes of characters: each letter, all digits together, and what is neither.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = LETTERS + "0 "
N = len(ALPHABET)
_CLASS = np.array([LETTERS.index(chr(c | 32)) if chr(c | 32) in LETTERS and c | 32 < 128 and chr(c).isalpha() else 26 if 48 <= c <= 57 else 27 for c in range(256)], np.int64)
#: Bytes of a text that are counted at a time.
PIECE = 1 << 22
#: Characters between the word and the value; of the value; how often its kind of character changes (small, large, digits, signs); bits a character from which it is no word.
REACH, LEAST, MOST, CHANGES, BITS = 24, 8, 64, 3, 5.5
WORDS = ("account", "login", "user", "credential", "password", "passwd", "passcode", "secret", "token", "key", "pin")
_SIGNS = r"!@#$%^&*_+~.-"
#: Hexadecimal digests, which say nothing by themselves.
DIGEST = "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N * N, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            data = f" {text or ''} ".encode("ascii", "replace")  # a byte a character
            for at in range(0, len(data) - 1, PIECE):
                kind = _CLASS[np.frombuffer(data[at : at + PIECE + 1], np.uint8)]
                total += np.bincount(kind[:-1] * N + kind[1:], minlength=N * N)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there // N, pa.int32()), pa.array(there % N, pa.int32()), pa.array(total[there])], names=["a", "b", "n"])


def pairs(docs: DataFrame) -> DataFrame:
    """(a, b, n): how often characters of class b follow those of class a in all texts, places in ALPHABET; N * N rows at most. A null text is empty."""
    return docs.select("text").mapInArrow(_counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def bits(counts: DataFrame) -> list[float]:
    """The surprise of each pair of classes in bits, with one more of each pair than were counted."""
    n = np.ones((N, N))
    for r in counts.collect():  # N * N rows at most
        n[r["a"], r["b"]] += r["n"]
    return (-np.log2(n / n.sum(1, keepdims=True))).round(9).ravel().tolist()


def find_random(docs: DataFrame, counts: DataFrame, words: tuple[str, ...] = WORDS, least_bits: float = BITS) -> DataFrame:
    """Spans of values that look random (D22), within REACH characters after one of the words, on its line, and what they surprise by.

    A value has letters and digits, its kind of character changes CHANGES times or more, and its
    neighbouring characters surprise by `least_bits` on average, by pairs() of a corpus; words with
    numbers after them, numbers and digests don't. A mark at its end is the sentence's. Null texts give
    nothing, equal rows equal spans.
    """
    lead = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    longest = max(map(len, words))
    found = matches(docs, {"value": (f"(?:^|[^A-Za-z0-9{_SIGNS}])([A-Za-z{_SIGNS}]*[0-9][A-Za-z0-9{_SIGNS}]*)", f"#(?i){lead}")}, around=REACH + longest + 2)
    near = F.col("before").rlike(rf"(?i)(?:{lead})(?:[^A-Za-z0-9\n][^\n]{{0,{REACH}}})?\z")
    own = found.where(near).withColumn("value", F.regexp_replace("value", "[.!-]+$", ""))
    own = own.where(F.length("value").between(LEAST, MOST) & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & ~F.col("value").rlike(DIGEST))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "s"), "[A-Z]+", "L"), "[0-9]+", "0"), "[^sL0]+", "-")
    own = own.withColumn("ce", F.col("cs") + F.length("value")).where(F.length(kinds) > CHANGES)
    table = F.array(*(F.lit(x) for x in bits(counts)))
    code = F.translate(F.lower("value"), "123456789", "000000000")
    place = F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.substring(code, i, F.lit(1))), F.lit(0)), F.lit(N)) - 1)
    own = own.withColumn("place", place)
    steps = F.transform(F.sequence(F.lit(0), F.length("value") - 2), lambda i: F.get(table, (F.get("place", i) * N + F.get("place", i + 1)).cast("int")))
    mean = F.round(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps), 6)
    fine = own.withColumn("bits", mean).where(F.col("bits") >= least_bits)
    return fine.select("doc_id", "cs", "ce", F.lit("CREDENTIAL").alias("type"), F.lit("random").alias("detector"), "value", "bits")
