"""Large dictionaries of terms: one automaton for all of them, one pass over each text (V9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veilworks.sources.shared import cut

#: Characters of terms that one automaton holds (about 100 bytes each in a worker); more terms go in blocks, each with a pass of its own.
BLOCK_CHARS = 2_000_000
#: Blanks that a text may have within a term, or a term within itself.
BLANKS = (0x20, 0x09)


def squeezed(term: Column) -> Column:
    """A term as automata hold it: no blanks, A to Z lower-cased."""
    return F.translate(F.regexp_replace(term, "[ \\t]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton:
    """All terms as one machine of states and failure links."""

    def __init__(self, terms: list[str]):
        self.machine = ahocorasick.Automaton()
        for t in terms:
            self.machine.add_word(t, len(t))
        self.machine.make_automaton()

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(cs, ce) of all terms in a text, overlapping ones too, with no ASCII letter or digit beside an edge that is one; the order is by ce, the longest first."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.flatnonzero((code != BLANKS[0]) & (code != BLANKS[1]))
        own = code[place]
        own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint32)
        found = [(end, size) for end, size in self.machine.iter(own.tobytes().decode("utf-32-le", "surrogatepass"))] if len(own) and len(self.machine) else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, size = np.array(found).T
        first, last = place[end - size + 1], place[end]
        sharp = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
        beside = np.concatenate([[False], sharp, [False]])
        free = ~(sharp[first] & beside[first]) & ~(sharp[last] & beside[last + 2])
        return first[free], last[free] + 1


def _found(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Automaton(sent.value)
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                cs, ce = own.hits(text or "")
                for at in range(0, len(cs), 1 << 16):
                    a, b = cs[at : at + (1 << 16)], ce[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(row, 1).take(pa.array(np.zeros(len(a), np.int64))), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array([text[x:y] for x, y in zip(a, b)], pa.string())],
                        names=["doc_id", "cs", "ce", "value"],
                    )

    return run


def find_dictionary(docs: DataFrame, terms: DataFrame, type_: str, detector: str = "Term", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Spans of the terms (V9, D23) of any dictionary (term), ASCII case and blanks ignored on both sides: all hits, overlapping ones too, each place once a row of docs.

    Where a hit begins or ends with an ASCII letter or digit, the character beside it must be none.
    Null terms and those of blanks only are an error (D0c); repeated ones count once; null texts give
    nothing, and equal rows of docs give equal spans. Each text is read once for each block of terms:
    a dictionary is cut by a hash into blocks of `block_chars` characters, each sent to the tasks as a
    list, from which a worker builds its automaton.
    """
    kept = cut(terms.select(F.coalesce(squeezed(F.col("term")), F.lit("")).alias("term")).distinct())
    chars, empty = kept.agg(F.coalesce(F.sum(F.length("term")), F.lit(0)), F.coalesce(F.bool_or(F.col("term") == ""), F.lit(False))).first()
    if empty:
        raise ValueError("an empty term")
    blocks, found = max(1, -(-chars // block_chars)), []
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("cs", IntegerType()), StructField("ce", IntegerType()), StructField("value", StringType())])
    for block in range(blocks):
        own = kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).toArrow().column("term").to_pylist()  # about block_chars characters
        found.append(docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_found(docs.sparkSession.sparkContext.broadcast(own)), kind))
    return reduce(DataFrame.unionByName, found).select("doc_id", "cs", "ce", F.lit(type_).alias("type"), F.lit(detector).alias("detector"), "value")
