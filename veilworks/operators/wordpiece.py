"""Pieces of words by a caller's vocabulary: the longest piece first (V12), and windows over them."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from veilworks.operators import parts

#: Pieces that a vocabulary may have; it is sent to all tasks.
MOST_PIECES = 1_000_000
#: What a piece within a word begins with, and the characters of a word that is looked at.
WITHIN, MOST_CHARS = "##", 100
#: Characters that are dropped, and those that are words of their own: punctuation and ideographs.
DROPPED = r"[[\x00�\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}]--[\t\n\r]]"
SPACE = r"\t\n\r\p{Zs}  "
ALONE = r"!-/:-@\[-`{-~\p{P}㐀-䶿一-鿿豈-﫿\U00020000-\U0002A6DF\U0002A700-\U0002CEAF\U0002F800-\U0002FA1F"
_DROPPED = regex.compile(f"(?V1){DROPPED}")
#: Rows that a task hands on at a time, and characters that it looks at together.
ROWS, CHARS = 1 << 16, 1 << 18
MARKS = [ord(c) for c in ".?!。"]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """What each character is: white space (0), a word of its own (1) or part of one (2)."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), 2, np.uint8)
    for k, of in enumerate((SPACE, ALONE)):
        for m in regex.finditer(f"(?V1)[{of}]+", every):
            kinds[m.start() : m.end()] = k
    return kinds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """A text in parts of up to CHARS characters, or of one word, and where each begins; no word is cut."""
    begin, size = 0, CHARS
    while len(text) - begin > size:
        kinds = _kinds()[_codes(text[begin : begin + size + 1])]
        ends = np.flatnonzero((kinds[:-1] != 2) | (kinds[1:] != 2))
        if len(ends):
            end = begin + int(ends[-1]) + 1
            yield begin, text[begin:end]
            begin, size = end, CHARS
        else:
            size *= 2
    if begin < len(text):
        yield begin, text[begin:]


def _groups(texts: Iterable[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """(row, begin, part) of texts, as many together as CHARS allows; what isn't a text's first part comes first in its group."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for begin, part in _parts(text or ""):
            if group and (begin or size + len(part) > CHARS):
                yield group
                group, size = [], 0
            group.append((row, begin, part))
            size += len(part)
    if group:
        yield group


@dataclass(frozen=True)
class Block:
    """The pieces of parts of texts: of each part its text's row, where it begins in codes, and its size; of each piece its part, number in its text, id, and place in codes and in its text."""

    codes: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    part: np.ndarray
    at: np.ndarray
    id: np.ndarray
    end: np.ndarray
    start: np.ndarray
    cs: np.ndarray
    ce: np.ndarray


def _reaches(ids: dict[str, int]) -> dict[str, int]:
    """How long pieces are that begin with the same two characters (or are one), the longest of them."""
    reaches: dict[str, int] = {}
    for p in ids:
        reaches[p[:2]] = max(len(p), reaches.get(p[:2], 0))
    return reaches


class Pieces:
    """A vocabulary, and the words met so far."""

    def __init__(self, ids: dict[str, int], unknown: int):
        self.unknown = unknown
        within = {p.removeprefix(WITHIN): i for p, i in ids.items() if p.startswith(WITHIN)}
        self.tables = [(x, _reaches(x)) for x in (ids, within)]  # at a word's start, and after it
        self.known = lru_cache(1 << 17)(self._spots)

    def _of(self, word: str) -> list[tuple[int, int, int]]:
        """(id, first, end) of each piece of a word; one unknown for all of it where no piece fits somewhere."""
        out, at, size = [], 0, len(word)
        if size > MOST_CHARS:
            return [(self.unknown, 0, size)]
        while at < size:
            ids, reaches = self.tables[at > 0]
            reach = reaches.get(word[at : at + 2]) or reaches.get(word[at], 0)
            for end in range(min(size, at + reach), at, -1):
                found = ids.get(word[at:end])
                if found is not None:
                    break
            else:
                return [(self.unknown, 0, size)]
            out.append((found, at, end))
            at = end
        return out

    def _spots(self, raw: str) -> bytes:
        """_of() a word as it stands in the text, its places there, as bytes of int64."""
        word = raw if raw.isascii() and raw.isprintable() else _DROPPED.sub("", raw)
        found = self._of(word) if word else []
        if len(word) < len(raw):
            kept = [k for k, c in enumerate(raw) if not _DROPPED.match(c)]
            found = [(i, kept[a], kept[b - 1] + 1) for i, a, b in found]
        return array("q", chain.from_iterable(found)).tobytes()

    def of(self, raw: str) -> bytes:
        return self.known(raw) if len(raw) <= MOST_CHARS else self._spots(raw)  # long words aren't kept

    def blocks(self, texts: Iterable[str | None]) -> Iterator[Block]:
        """The pieces of texts in order, by columns: of the words of a group of texts each is looked up once."""
        count = 0
        for group in _groups(texts):
            rows, begins, sizes = (np.array(x, np.int64) for x in ([g[0] for g in group], [g[1] for g in group], [len(g[2]) for g in group]))
            joined = "\n".join(g[2] for g in group)
            codes, firsts = _codes(joined), np.cumsum(sizes + 1) - sizes - 1
            kinds = np.concatenate([[0], _kinds()[codes], [0]]).astype(np.uint8)
            here, before, after = kinds[1:-1], kinds[:-2], kinds[2:]
            first = np.flatnonzero((here == 1) | ((here == 2) & (before != 2)))
            last = np.flatnonzero((here == 1) | ((here == 2) & (after != 2))) + 1
            words = _words(joined, codes, first, last).dictionary_encode()
            spots = [self.of(w) for w in words.dictionary.to_pylist()]
            flat = np.frombuffer(b"".join(spots), np.int64).reshape(-1, 3)
            n = np.array([len(s) // 24 for s in spots], np.int64)
            word = np.asarray(words.indices, np.int64)
            each = n[word]
            which = np.repeat((np.cumsum(n) - n)[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            ids, a, b = flat[which].T
            part = np.repeat(np.searchsorted(firsts, first, "right") - 1, each)
            start = np.repeat(first, each)
            pieces = np.bincount(part, minlength=len(group))
            at = np.arange(len(part)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            count = count if begins[0] else 0
            at[: pieces[0]] += count
            count = int(pieces[-1]) + (count if len(group) == 1 else 0)
            move = (begins - firsts)[part]
            yield Block(codes, rows, firsts, sizes, part, at, ids, start + b, start + a, start + a + move, start + b + move)

    def encode(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(id, cs, ce) of the pieces of a text, in order."""
        for b in self.blocks([text]):
            yield from zip(b.id.tolist(), b.cs.tolist(), b.ce.tolist())


def _words(text: str, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words that lie between places of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) > len(codes):
        place = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        first, last = place[first], place[last]
    sizes = last - first
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = data[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(own))


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column("text"))


def _pieces(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*sent.value)
        for batch in batches:
            for b in own.blocks(_texts(batch)):
                for k in range(0, len(b.id), ROWS):
                    to = slice(k, k + ROWS)
                    doc_id = batch.column("doc_id").take(pa.array(b.rows[b.part[to]]))
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(b.at[to], pa.int32()), pa.array(b.id[to]), pa.array(b.cs[to], pa.int32()), pa.array(b.ce[to], pa.int32())], names=["doc_id", "at", "id", "cs", "ce"])

    return run


def _cuts(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*sent.value)
        for batch in batches:
            size = len(batch)
            n, so_far, ends, lines_there = np.zeros((4, size), np.int64)  # pieces and line ends of each text; where its latest piece ends, and line ends before that
            marked = np.zeros(size, bool)
            rows, cuts = [], []
            for b in own.blocks(_texts(batch)):
                lines = np.concatenate([[0], np.cumsum((b.codes == 10) | (b.codes == 13))])
                row, off = b.rows[b.part], (so_far[b.rows] - lines[b.firsts])[b.part]
                mark, there = np.isin(b.codes[b.end - 1], MARKS), lines[b.end] + off
                same = np.concatenate([[False], row[1:] == row[:-1]])[: len(row)]
                prior = lambda x, latest: np.where(same, np.roll(x, 1), latest[row])  # noqa: B023, E731
                cut = (b.at > 0) & ((prior(mark, marked) & (b.cs > prior(b.ce, ends))) | (lines[b.start] + off > prior(there, lines_there)))
                rows.append(row[cut])
                cuts.append(b.at[cut] - 1)
                n[row], ends[row], lines_there[row], marked[row] = b.at + 1, b.ce, there, mark  # the last of each text stays
                so_far[b.rows] += lines[b.firsts + b.sizes] - lines[b.firsts]
            closed = np.flatnonzero((n > 0) & (marked | (so_far > lines_there)))
            row = np.concatenate([*rows, closed])
            cut = np.concatenate([*cuts, n[closed] - 1])[np.argsort(row, kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cut, pa.int32()))], names=["doc_id", "n", "cuts"])

    return run


def _sent(docs: DataFrame, vocabulary: DataFrame, unknown: str):
    n = vocabulary.count()
    if n > MOST_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces; {MOST_PIECES} are allowed")
    ids = {r["piece"]: r["id"] for r in vocabulary.select("piece", "id").toLocalIterator()}
    if unknown not in ids:
        raise ValueError("the vocabulary lacks the unknown piece")
    return docs.sparkSession.sparkContext.broadcast((ids, ids[unknown]))


def pieces(docs: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """(doc_id, at, id, cs, ce) of every text's pieces (V12), in order from 0, with their places in code points.

    Texts are cut at white space and around punctuation and ideographs, controls being dropped; each word
    is cut from its start into the longest pieces of vocabulary (piece, id), those after the first
    marked by WITHIN; a word that can't be, or of over MOST_CHARS characters, is one unknown piece.
    Null and empty texts give nothing; equal rows give equal pieces. The vocabulary has MOST_PIECES at
    most, else it's an error. A word is cut once a task, as long as it is among the latest 131,072,
    and looked up once for each group of texts.
    """
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("at", IntegerType()), StructField("id", LongType()), StructField("cs", IntegerType()), StructField("ce", IntegerType())])
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_pieces(_sent(docs, vocabulary, unknown)), kind)


def windows(docs: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """(doc_id, at, first, end, overloaded): windows over the pieces of each text (V11), ending after one that ends a sentence where they can: a mark before something other than the next piece, or a line end."""
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", IntegerType()), StructField("cuts", ArrayType(IntegerType()))])
    counted = docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_cuts(_sent(docs, vocabulary, unknown)), kind)
    return parts.token_windows(counted, F.col("n"), F.col("cuts"))
