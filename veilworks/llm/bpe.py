"""Byte-level BPE: overlapping chunks are split into pre-tokens in parallel, stitched, and encoded; decoding joins raw bytes."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, small_batches, table

RANKS = "byte_bpe_50k.tiktoken"
#: Code points of a chunk, and by how many it reaches into the next.
CHUNK = 1024
OVERLAP = 128
#: Code points up to which the chunks of a text are stitched by the worker that holds it; those of longer texts are dealt over tasks.
NEAR = 65_536


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def encode_piece(text: str, path: str) -> np.ndarray:
    """The ids of a piece that starts and ends at pre-token boundaries."""
    return _encoding(path).encode_to_numpy(text, disallowed_special=()).view(np.int32)


def boundaries(text: str, first: int, upto: int) -> list[int]:
    """Ends of the pre-tokens of text that lie in [first, upto) after a character that is no white space.

    White space alone depends on what follows it, so the text on both sides of such an end has the
    same pre-tokens on its own as it has within the whole.
    """
    return [e for m in _pattern().finditer(text) if first <= (e := m.end()) < upto and not text[e - 1].isspace()]


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str, str]]:
    """(number, text, the start of the next chunk, which it overlaps) of each chunk."""
    n = max(1, -(-len(text) // size))
    for k in range(n):
        yield k, text[k * size : (k + 1) * size], text[(k + 1) * size : (k + 1) * size + overlap]


def pieces(text: str, size: int, overlap: int) -> list[str]:
    """The text cut where the pre-tokens of neighbouring chunks fall into step, as stitched() does it for chunks that lie apart."""
    if len(text) <= size:
        return [text]
    cuts, tail = [0], frozenset()
    for k, own, more in chunks(text, size, overlap):
        at = boundaries(own + more, 1, len(own) + len(more))
        meet = next((e for e in at if e in tail), 0) if k else 0
        if meet:
            cuts.append(k * size + meet)
        tail = frozenset(e - len(own) for e in at if e > len(own)) if more else frozenset()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _long_rows(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of each text, with the pre-token ends in its first and in its overlapping characters."""
    for batch in arrow_rows(batches, 16):
        for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
            for k, own, more in chunks(text, size, overlap):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), pa.array([k], pa.int32()), pa.array([own], pa.string()), pa.array([more], pa.string())], ["key", "k", "own", "more"])


def _with_ends(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, 64):
        heads, tails = [], []
        for k, own, more in zip(*(batch.column(c).to_pylist() for c in ("k", "own", "more"))):
            at = boundaries(own + more, 1, len(own) + len(more))
            heads.append([e for e in at if e < overlap] if k else [])
            tails.append([e - len(own) for e in at if e > len(own)] if more else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["key", "k", "own", "head", "tail"])


def _encoded(path: str, size: int, overlap: int, decoded: str | None = None) -> Callable:
    """Ids of the texts in the last column, encoded piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 1024):
            counts = np.zeros(batch.num_rows + 1, np.int64)
            parts = [np.zeros(0, np.int32)]
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist(), 1):
                own = [encode_piece(piece, path) for piece in pieces(text or "", size, overlap)]
                counts[i] = sum(map(len, own))
                parts += own
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate(parts)))
            more = [_joined(ids, path)] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *more], [*batch.schema.names[:-1], "ids", *[decoded] * len(more)])

    return run


def stitched(long: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """long (key, text), keys unique -> pieces (key, k, piece) that start and end where pre-tokens do.

    Each chunk is split into pre-tokens from its own start, which may lie within one. Where an end
    that it finds in its first characters is also one that the chunk before finds in its overlap,
    both have fallen into step, and the piece is cut there. A chunk that doesn't fall into step in
    its overlap is joined with the one before, so pieces are exact whatever the text.
    """
    key = long.schema["key"].dataType.simpleString()
    rows = long.select("key", "text").mapInArrow(lambda b: _long_rows(b, size, overlap), f"key {key}, k int, own string, more string")
    ended = rows.repartition("key", "k").mapInArrow(lambda b: _with_ends(b, size, overlap), f"key {key}, k int, own string, head array<int>, tail array<int>")
    in_text = Window.partitionBy("key").orderBy("k")
    # Cut j of a chunk: at character j of it, or -1 if it never fell into step with the one before.
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    cut = ended.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.coalesce(meet, F.lit(-1))))
    moved = cut.withColumn("next_cut", F.lead("cut").over(in_text)).withColumn("next_own", F.lead(F.substring("own", 1, overlap)).over(in_text))
    own = F.substring("own", F.greatest("cut", F.lit(0)) + 1, F.lit(size))
    reach = F.when(F.col("next_cut") > 0, F.substring("next_own", F.lit(1), F.col("next_cut"))).otherwise("")
    runs = moved.select("key", "k", F.concat(own, reach).alias("part"), F.sum(F.when(F.col("cut") >= 0, 1).otherwise(0)).over(in_text).alias("run"))
    return runs.groupBy("key", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda s: s["part"]), "").alias("piece")).select("key", F.col("run").alias("k"), "piece")


def encode(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str | None = None, size: int = CHUNK, overlap: int = OVERLAP, near: int = NEAR, decoded: str | None = None
) -> DataFrame:
    """(key, ids array<int>) of every row: the token ids of its whole text, without special tokens.

    Texts are cut into overlapping chunks of `size`, which are split into pre-tokens on their own,
    stitched where pre-token boundaries resynchronise, and encoded piece by piece. A text of up to
    `near` code points stays with its worker, so nothing of it is shuffled; the chunks of a longer one
    are dealt over tasks. A null text counts as empty and has no ids. Rows of the same key and text
    give as many equal rows; rows of the same key, null keys too, with other texts are kept apart. An
    empty table gives an empty one. ranks is the path of a rank file on every node.
    With `decoded`, a column of that name holds the bytes that the ids decode to; the worker that
    encodes a text decodes its ids too, so a task needs one Python worker, not two.
    """
    path = ranks or public_tokenizers.path(RANKS)
    rows = small_batches(df).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    short = rows.where(F.length("text") <= near).mapInArrow(_encoded(path, size, overlap, decoded), f"key {kind}, ids array<int>" + (f", {decoded} binary" if decoded else ""))
    held = rows.where(F.length("text") > near).groupBy("key", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    stitches = stitched(held.select(F.struct("key", "sha", "n").alias("key"), "text"), size, overlap)
    done = stitches.repartition("key", "k").mapInArrow(_encoded(path, size, overlap), f"{stitches.schema['key'].simpleString()}, k bigint, ids array<int>".replace("key:", "key ", 1))
    joined = done.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).alias("ids"))
    copies = joined.select(F.col("key.key").alias("key"), "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("key.n"))).alias("_")).drop("_")
    return short.unionByName(decode(copies, out=decoded, ranks=path) if decoded else copies).withColumnRenamed("key", key)


def decode(df: DataFrame, *, ids: str = "ids", out: str = "bytes", ranks: str | None = None) -> DataFrame:
    """df with `out`: the raw bytes that the ids stand for, one after the other. Null ids give null; an unknown id is an error."""
    path = ranks or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([_joined(column.slice(at, 1024), path) for at in range(0, len(column), 1024)] or [pa.array([], pa.binary())])

    return df.withColumn(out, raw(ids))


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each id's start and how many they are."""
    ranks = _ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int32)
    by_id = sorted(ranks.items(), key=lambda x: x[1])
    lengths[[i for _, i in by_id]] = [len(b) for b, _ in by_id]
    return np.frombuffer(b"".join(b for b, _ in by_id), np.uint8), (np.cumsum(lengths) - lengths).astype(np.int32), lengths


def _joined(lists: pa.Array, path: str) -> pa.Array:
    """The bytes of each list of ids, gathered for all of them at once."""
    pool, starts, lengths = _bytes_of_ids(path)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    ids = np.asarray(lists.flatten())
    if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
        raise ValueError("an id that is not in the ranks")
    n = lengths[ids]
    ends = np.cumsum(n, dtype=np.int64)
    where = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts[ids] - (ends - n)).astype(np.int32), n)
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    flat = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(pool[where])])
    return pa.compute.if_else(lists.is_valid(), flat, pa.scalar(None, pa.binary()))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; the digests are taken from the ids and from the decoded bytes."""
    return digests(encode(table(spark, sf_dir, "documents"), decoded="bytes"))


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """For each row of encoded (doc_id, ids, bytes) the number of ids, and digests of the ids and of the bytes that they decode to."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"), *["ids"] * keep_ids,
    )
