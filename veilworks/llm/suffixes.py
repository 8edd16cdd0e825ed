"""Repeated passages by prefix-free parsing: texts are cut into phrases at rolling-hash triggers, equal phrases are kept once, and the suffixes of what is left are sorted, part by part, to find those that share their first bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import cut, small_batches, table

#: Bytes of a passage.
DEPTH = 50
#: Bytes of a rolling hash, and how many of them a passage holds.
W = 16
PLACES = DEPTH - W + 1
#: Bytes beside an anchor of which each passage has as many on one side at least.
SIDE = (DEPTH - W + 1) // 2
#: One place in so many is a trigger, where a phrase begins; a phrase has no more starts than LONGEST.
EVERY, LONGEST = 256, 1 << 13
#: Starts of a text that are looked at together; bytes of all texts that are.
PIECE, TOGETHER = 1 << 18, 1 << 18
#: Keys that a task gathers before it hands them on, and keys that one group of the next step has.
FLUSH, BUCKET = 1 << 19, 1 << 19
#: Rows that share a doc_id are dealt over so many groups.
TAGS = 1 << 8
#: Bits of an anchor's hash that tell anchors apart; more would only rule out a few passages more.
ANCHOR = np.uint64((1 << 64) - (1 << 16))
#: Ranks after every other doc_id, for rows without one.
NO_ID = (1 << 63) - 1
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), np.uint64)
_PLACE_BITS = 22
HELD = "doc long, tag int, a long, b long, settled boolean"
DEALT = "bucket int, sent binary, told binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the W bytes from each place on."""
    h, base, size = _BYTES[data], _MIX[0], 1
    while size < W:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base & (1 << 64) - 1, 2 * size
    return mixed(h)


def anchors(h: np.ndarray) -> np.ndarray:
    """For each start of DEPTH bytes the place of the least rolling hash in them: equal passages have it at the same place."""
    place = np.arange(len(h), dtype=np.uint64)
    least = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place
    size = 1
    while 2 * size <= PLACES:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = PLACES - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def words_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The DEPTH bytes from each start on, as columns of numbers that sort as the bytes do."""
    width = -(-DEPTH // 8) * 8
    cells = np.zeros((len(starts), width), np.uint8)
    cells[:, :DEPTH] = data[starts[:, None] + np.arange(DEPTH)]
    return cells.view(">u8").astype(np.uint64)


def passage_hash(words: np.ndarray) -> np.ndarray:
    h = np.full(len(words), _MIX[2], np.uint64)
    for column in words.T:
        h = mixed((h ^ column) * np.uint64(_MIX[0]))
    return h


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    changed = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, changed)) if len(columns[0]) else np.zeros(0, np.int64)


class Pieces:
    """Texts side by side, each a piece of bounded size: the bytes, which starts are passages, and of which row."""

    def __init__(self, held: list[tuple[int, bytes]]):
        self.rows = np.array([r for r, _ in held])
        sizes = np.array([len(b) for _, b in held])
        self.at = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        self.hash = rolling(self.data)
        self.starts = len(self.data) - DEPTH + 1
        self.owner = np.repeat(np.arange(len(held)), sizes)[: self.starts]
        self.fits = np.arange(self.starts) + DEPTH <= (self.at + sizes)[self.owner]

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """For each start of a passage, ascending: where its anchor is; and where the SIDE + W bytes begin that reach from the anchor to the side on which the passage has more."""
        place, start = anchors(self.hash), np.arange(self.starts)
        return place, np.where(place - start >= SIDE, place - SIDE, place)

    def wide(self, at: np.ndarray) -> np.ndarray:
        """The hash of the SIDE + W bytes from each place on."""
        return mixed((self.hash[at] * np.uint64(_MIX[2])) ^ self.hash[at + SIDE])

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, row) of each phrase: the starts from one trigger to the next. Its text goes DEPTH - 1 bytes on, so it holds the end of the next trigger, and all of each passage that begins in it."""
        trigger = (self.hash[: self.starts] % np.uint64(EVERY) == 0) & self.fits
        trigger[self.at[self.at < self.starts]] = True
        trigger &= self.fits
        # Places of a text that no passage begins at lie at its end, so phrases end there.
        begin = np.flatnonzero(trigger)
        if not len(begin):
            return begin, begin, begin
        last = np.append(begin[1:], self.starts)
        owner = self.owner[begin]
        fitting = np.bincount(self.owner[self.fits], minlength=len(self.at))
        end = np.minimum(last, self.at[owner] + fitting[owner])
        pieces = -(-(end - begin) // LONGEST)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + part * LONGEST
        return begin, np.minimum(np.repeat(end, pieces), begin + LONGEST), self.rows[np.repeat(owner, pieces)]

    def digests(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits of each phrase's text."""
        data = memoryview(self.data)
        joined = b"".join(hashlib.blake2b(data[a : b + DEPTH - 1], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist()))
        return np.frombuffer(joined, np.int64).reshape(-1, 2)


def pieces_of(texts: list[str | None]) -> Iterator[tuple[Pieces, list[int]]]:
    """The texts in pieces, some together; and where each piece begins in its text. A long text's pieces overlap, so that no passage is cut."""
    held, offsets, total = [], [], 0
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        for at in range(0, len(data) - DEPTH + 1, PIECE):
            piece = data[at : at + PIECE + DEPTH - 1]
            held.append((row, piece))
            offsets.append(at)
            total += len(piece)
            if total >= TOGETHER:
                yield Pieces(held), offsets
                held, offsets, total = [], [], 0
    if held:
        yield Pieces(held), offsets


class Known:
    """The keys of some rows of a batch, to look others up in."""

    def __init__(self, column: pa.Array, rows: np.ndarray, half: bool = False):
        low, high = int(rows[0]), int(rows[-1]) + 1
        lists = column.slice(low, high - low)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        values = lists.flatten()
        a, b = (np.asarray(values.field(k), np.int64).view(np.uint64) for k in ("a", "b"))
        self.half = half
        self.row, self.a, self.b = np.repeat(np.arange(low, high), sizes), a, np.zeros_like(b) if half else b
        code = self._code(self.row, self.a, self.b)
        order = np.argsort(code, kind="stable")
        self.row, self.a, self.b, self.code = self.row[order], self.a[order], self.b[order], code[order]

    @staticmethod
    def _code(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((a ^ (row.astype(np.uint64) * np.uint64(_MIX[0]))) + b * np.uint64(_MIX[2]))

    def has(self, row: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        """Whether each row has this key, or with half one that begins with a."""
        if not len(self.code) or not len(row):
            return np.zeros(len(row), bool)
        b = np.zeros(len(row), np.uint64) if b is None else b.view(np.uint64)
        a = a.view(np.uint64)
        spot = np.minimum(np.searchsorted(self.code, self._code(row, a, b)), len(self.code) - 1)
        return (self.row[spot] == row) & (self.a[spot] == a) & (self.b[spot] == b)


def _first(doc: np.ndarray, tag: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tag, a, b), each row once, by key and then doc; where each key's rows begin; and each row's key."""
    order = np.lexsort((tag, doc, keys[:, 1], keys[:, 0]))
    doc, tag, keys = doc[order], tag[order], keys[order]
    same_key = np.append(False, (keys[1:] == keys[:-1]).all(1))
    fresh = ~(same_key & np.append(False, (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])))
    doc, tag, keys = doc[fresh], tag[fresh], keys[fresh]
    at = np.flatnonzero(~np.append(False, (keys[1:] == keys[:-1]).all(1))) if len(doc) else np.zeros(0, np.int64)
    return doc, tag, keys, at, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc))))


def settled(doc: np.ndarray, tag: np.ndarray, keys: np.ndarray, shared: bool) -> tuple[np.ndarray, ...]:
    """What a part can tell of its keys: (doc, tag, keys, decided, sent). Decided rows have their key in a smaller doc (shared: in another doc) of the part; sent rows are those that other parts must know of: of the smallest doc, and if shared also of the largest."""
    doc, tag, keys, at, group = _first(doc, tag, keys)
    if not len(doc):
        return doc, tag, keys, np.zeros(0, bool), np.zeros(0, bool)
    low, high = doc[at][group], doc[np.append(at[1:], len(doc)) - 1][group]
    if shared:
        return doc, tag, keys, low != high, (doc == low) | (doc == high)
    return doc, tag, keys, doc > low, doc == low


def varied(keys: np.ndarray) -> np.ndarray:
    """Which rows of keys, sorted, have the first half of their key in another key too."""
    if not len(keys):
        return np.zeros(0, bool)
    at = np.flatnonzero(np.append(True, keys[1:, 0] != keys[:-1, 0]))
    last = np.append(at[1:], len(keys)) - 1
    return np.repeat(keys[at, 1] != keys[last, 1], last - at + 1)


def planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest byte of all, and so on, so that what is alike lies together."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def numbers(data: bytes, n: int, at: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def packed(doc: np.ndarray, tag: np.ndarray, keys: np.ndarray) -> bytes:
    return b"".join((planes(keys[:, 0].copy()), planes(keys[:, 1].copy()), planes(doc), planes(tag.astype(np.int16))))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 26
    return numbers(data, n, 16 * n, np.int64), numbers(data, n, 24 * n, np.int16).astype(np.int64), np.stack([numbers(data, n, 0, np.int64), numbers(data, n, 8 * n, np.int64)], 1)


def _parted(kind: str, bucket: np.ndarray, doc: np.ndarray, tag: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    parts = np.split(order, edges[1:]) if len(edges) else []
    for i in range(0, len(parts), 4096):
        own = parts[i : i + 4096]
        data = pa.array([packed(doc[p], tag[p], keys[p]) for p in own], pa.binary())
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[[p[0] for p in own]].astype(np.int32)), data if kind == "sent" else none, data if kind == "told" else none], names=["bucket", "sent", "told"])


def _handed(doc: np.ndarray, tag: np.ndarray, keys: np.ndarray, shared: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows: keys that other parts must know of go to their bucket, settled ones to any, so that a key in many rows fills none."""
    doc, tag, keys, decided, sent = settled(doc, tag, keys, shared)
    any_ = (mixed((doc[decided] * TAGS + tag[decided]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    yield from _parted("told", any_, doc[decided], tag[decided], keys[decided])
    bucket = (mixed(keys[sent, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    yield from _parted("sent", bucket, doc[sent], tag[sent], keys[sent])


def _emitted(found: Callable, shared: bool, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs found(batch row columns, pieces) over all texts, and hands on (row, keys) by FLUSH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            doc, tag = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("tag"), np.int64)
            for pieces, _ in pieces_of(batch.column("text").to_pylist()):
                rows, keys = found(batch, pieces)
                held.append((doc[rows], tag[rows], keys))
                n += len(rows)
                if n >= FLUSH:
                    yield from _handed(*map(np.concatenate, zip(*held)), shared, buckets)
                    held, n = [], 0
        if n:
            yield from _handed(*map(np.concatenate, zip(*held)), shared, buckets)

    return run


def _met(shared: bool, open_: bool) -> Callable[[pa.Table], pa.Table]:
    """What the parts of a bucket tell together: (doc, tag, a, b, settled) of keys that a smaller doc (shared: another doc) holds; with open_ also, not settled, of those that begin like another key."""

    def run(rows: pa.Table) -> pa.Table:
        out = [(*unpacked(data), True) for data in rows.column("told").drop_null().to_pylist()]
        held = [unpacked(data) for data in rows.column("sent").drop_null().to_pylist()]
        if held:
            doc, tag, keys, decided, _ = settled(*map(np.concatenate, zip(*held)), shared)
            out.append((doc[decided], tag[decided], keys[decided], True))
            if open_:
                more = varied(keys) & ~decided
                out.append((doc[more], tag[more], keys[more], False))
        doc, tag, keys = (np.concatenate([x[i] for x in out]) for i in range(3))
        return pa.table({"doc": doc, "tag": tag.astype(np.int32), "a": keys[:, 0], "b": keys[:, 1], "settled": np.repeat([x[3] for x in out], [len(x[0]) for x in out])})

    return run


def known_elsewhere(found: DataFrame, shared: bool, name: str, open_: str | None = None) -> DataFrame:
    """(doc, tag, name): the keys of each group of rows that a smaller doc (shared: another doc) holds too; in `open_` its keys that aren't, but begin like another."""
    met = found.groupBy("bucket").applyInArrow(_met(shared, bool(open_)), HELD)
    key = F.struct("a", "b")
    lists = [F.collect_list(F.when(F.col("settled"), key)).alias(name)] + ([F.collect_list(F.when(~F.col("settled"), key)).alias(open_)] if open_ else [])
    return met.groupBy("doc", "tag").agg(*lists)


def _by_phrase(batch: pa.RecordBatch, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    begin, end, rows = pieces.phrases()
    return rows, pieces.digests(begin, end)


def _covered(batch: pa.RecordBatch, pieces: Pieces) -> np.ndarray:
    """The starts whose whole phrase a smaller doc holds."""
    out = np.zeros(pieces.starts + 1, np.int64)
    known = Known(batch.column("phrases"), pieces.rows)
    if len(known.code):
        begin, end, rows = pieces.phrases()
        mine = np.isin(rows, known.row)
        begin, end, rows = begin[mine], end[mine], rows[mine]
        digests = pieces.digests(begin, end)
        hit = known.has(rows, digests[:, 0], digests[:, 1])
        np.add.at(out, begin[hit], 1)
        np.add.at(out, end[hit], -1)
    return np.cumsum(out)[:-1] > 0


def _by_anchor(batch: pa.RecordBatch, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the passages in phrases that no smaller doc holds."""
    at = pieces.keyed()[0][pieces.fits & ~_covered(batch, pieces)]
    at = at[edges_of(at)]
    keys = np.zeros((len(at), 2), np.int64)
    keys[:, 0] = (pieces.hash[at] & ANCHOR).view(np.int64)
    return pieces.rows[np.searchsorted(pieces.at, at, "right") - 1], keys


class Left:
    """The passages of some pieces in phrases of their own, by anchor."""

    def __init__(self, batch: pa.RecordBatch, pieces: Pieces):
        self.batch, self.pieces, self.gone = batch, pieces, _covered(batch, pieces) & pieces.fits
        self.starts = np.flatnonzero(pieces.fits & ~self.gone)
        self.rows = pieces.rows[pieces.owner[self.starts]]
        self.place, self.at = (x[self.starts] for x in pieces.keyed())

    def begin(self, column: str) -> np.ndarray:
        """Which have an anchor (column shared) or wider key that begins a key of their row."""
        known = Known(self.batch.column(column), self.pieces.rows, half=True)
        first = edges_of(self.place if column == "shared" else self.at, self.rows)
        hashes = self.pieces.hash[self.place[first]] & ANCHOR if column == "shared" else self.pieces.wide(self.at[first])
        return np.repeat(known.has(self.rows[first], hashes), np.diff(np.append(first, len(self.rows))))

    def stretches(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the kept passages: their numbers; where stretches, neighbours of one place, begin among them; the size of each, and its key: the hash there and that of all its text."""
        mine = np.flatnonzero(kept)
        starts = self.starts[mine]
        first = edges_of(starts - np.arange(len(starts)), self.at[mine], self.pieces.owner[starts])
        size = np.diff(np.append(first, len(starts)))
        data = memoryview(self.pieces.data)
        said = b"".join(hashlib.blake2b(data[a : a + n + DEPTH - 1], digest_size=8).digest() for a, n in zip(starts[first].tolist(), size.tolist()))
        return mine, first, size, np.stack([self.pieces.wide(self.at[mine[first]]).view(np.int64), np.frombuffer(said, np.int64)], 1)

    def inside(self, column: str) -> np.ndarray:
        """The numbers of the passages whose stretches are among their rows' keys."""
        mine, first, size, keys = self.stretches(self.begin(column))
        hit = Known(self.batch.column(column), self.pieces.rows).has(self.rows[mine[first]], keys[:, 0], keys[:, 1])
        return mine[np.repeat(hit, size)]


def _by_stretch(batch: pa.RecordBatch, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    left = Left(batch, pieces)
    mine, first, _, keys = left.stretches(left.begin("shared"))
    return left.rows[mine[first]], keys


def _by_suffix(batch: pa.RecordBatch, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, to DEPTH bytes, of the dictionary's passages that may be in other phrases: each distinct passage once a row."""
    left = Left(batch, pieces)
    mine = left.inside("open")
    rows, wide = left.rows[mine], pieces.wide(left.at[mine])
    if not len(mine):
        return rows, np.zeros((0, 2), np.int64)
    words = words_of(pieces.data, left.starts[mine])
    order = np.lexsort((rows, *words.T[::-1]))
    words, rows, wide = words[order], rows[order], wide[order]
    first = edges_of(rows, *words.T)
    return rows[first], np.stack([wide[first], passage_hash(words[first])], 1).view(np.int64)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<at:long,end:long>>, kept binary"


def _cleaned(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column("text").to_pylist(), {}
            for pieces, offsets in pieces_of(texts):
                left = Left(batch, pieces)
                gone = left.gone
                gone[left.starts[left.inside("stretches")]] = True
                mine = np.flatnonzero(left.begin("repeated") & ~gone[left.starts])
                if len(mine):
                    keys = pieces.wide(left.at[mine]), passage_hash(words_of(pieces.data, left.starts[mine]))
                    gone[left.starts[mine][Known(batch.column("repeated"), pieces.rows).has(left.rows[mine], *keys)]] = True
                at = np.flatnonzero(gone)
                owner = pieces.owner[at]
                for piece in np.unique(owner):
                    removed.setdefault(int(pieces.rows[piece]), []).append(at[owner == piece] - pieces.at[piece] + offsets[piece])
            out = []
            for row, text in enumerate(texts):
                data, spans = (text or "").encode("utf-8", "replace"), []
                kept = data
                if row in removed:
                    starts = np.unique(np.concatenate(removed[row]))
                    first = np.append(True, starts[1:] > starts[:-1] + DEPTH)
                    begin, end = starts[first], np.append(starts[:-1][first[1:]], starts[-1]) + DEPTH
                    spans = [{"at": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                    edges = [0, *(x for s in spans for x in (s["at"], s["end"])), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if whole else None))
            n, gone, spans, digest, where, kept = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(where, pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row of docs (doc_id, text): what is left of the UTF-8 bytes after removing each that a DEPTH-byte passage covers which also begins in a row of a smaller doc_id.

    Null texts are empty. Rows of equal doc_id don't count as smaller than one another, so equal
    rows stay alike; a null doc_id is larger than every other. Texts of under DEPTH bytes are left
    whole, an empty table gives none, and other columns are left alone. spans are byte ranges, kept is
    null unless keep_text.

    1. Every text is cut into phrases where a rolling hash of W bytes says so, which depends on those
    bytes alone; each phrase runs on over the next trigger, as far as its last passage does. A phrase
    that a smaller doc holds goes as a whole: the dictionary has it once.
    2. Within what is left, each passage has an anchor, its least rolling hash. Anchors that no other
    doc has rule out their passages, which is most of them.
    3. Neighbouring passages of one anchor, on one side of it, are a stretch, a finer parse of the
    dictionary. A stretch that a smaller doc holds goes as a whole; one whose anchor comes with these
    SIDE bytes beside it in no other stretch is left as it is.
    4. What is left are suffixes of dictionary phrases, each with as much of what follows in the parse
    as its first DEPTH bytes need. Each part sorts its own; equal neighbours are one passage, and the
    parts' suffix arrays meet by passage.

    In each step a part (FLUSH keys of a task) settles what it can by itself and hands on a key once,
    for its smallest doc, so a passage in any number of documents is a row a part at most. Keys meet in
    buckets of bounded size. A doc's own findings go back to it in groups of TAGS; texts are shuffled by
    that, once for a plan.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    tag = F.pmod(F.xxhash64("text"), F.lit(TAGS)).cast("int")
    read = small_batches(docs.select("doc_id", doc.alias("doc"), tag.alias("tag"), "text"))
    size = read.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = lambda share: max(1, size // share // BUCKET)
    emit = lambda rows, found, shared, share: rows.mapInArrow(_emitted(found, shared, buckets(share)), DEALT)
    phrases = cut(known_elsewhere(emit(read, _by_phrase, False, EVERY), False, "phrases"))
    first = read.join(phrases, ["doc", "tag"], "left")
    shared = known_elsewhere(emit(first, _by_anchor, True, PLACES // 2), True, "shared")
    stretches = known_elsewhere(emit(first.join(shared, ["doc", "tag"], "left"), _by_stretch, False, PLACES), False, "stretches", "open")
    third = first.join(stretches, ["doc", "tag"], "left")
    repeated = known_elsewhere(emit(third, _by_suffix, False, PLACES), False, "repeated")
    return third.join(repeated, ["doc", "tag"], "left").mapInArrow(_cleaned(keep_text), KEPT)


def op12_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("spans", "kept")


OP12_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS d, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT d, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM docs WHERE octet_length(b) >= 50),
passages AS (SELECT d, doc_id, i, md5(array_slice(b, i, i + 49)) AS p FROM starts),
gone AS (SELECT d, i FROM (SELECT d, i, doc_id, min(doc_id) OVER (PARTITION BY p) AS first FROM passages) WHERE doc_id > first),
runs AS (SELECT d, i, CASE WHEN i > 50 + lag(i) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM gone WINDOW w AS (PARTITION BY d ORDER BY i)),
numbered AS (SELECT d, i, sum(fresh) OVER (PARTITION BY d ORDER BY i) AS run FROM runs),
spans AS (SELECT d, run, min(i) AS a, max(i) + 50 AS e FROM numbered GROUP BY d, run),
removed AS (SELECT d, sum(e - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS begins, list(e ORDER BY a) AS ends FROM spans GROUP BY d),
kept AS (
  SELECT doc_id, b, n_removed, n_spans, CASE WHEN n_spans IS NULL THEN hex(b) ELSE
    list_aggregate(list_transform(range(0, n_spans + 1), lambda k: hex(array_slice(b, CASE WHEN k = 0 THEN 1 ELSE ends[k] END, CASE WHEN k = n_spans THEN octet_length(b) ELSE begins[k + 1] - 1 END))), 'string_agg', '') END AS h
  FROM docs LEFT JOIN removed USING (d))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""
