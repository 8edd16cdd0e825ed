"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, hash_share, table, written

#: Vectors on which the codebooks are fitted, about; the sample depends on the ids only. Every vector is indexed.
SAMPLE = 20_000
#: Components of a part, and codewords of a part's book (four bits).
PART, BOOK = 2, 16
#: Inner products below this share of the norms aren't sought, which sets the price of parallel error.
THRESHOLD = 0.2
#: Vectors scanned together, and those of them that are reranked first for each query, best approximate ones first; then come all that may be nearer than the k-th found.
ROWS, RERANK = 8192, 200
#: Queries that are broadcast together; more go in several jobs.
QUERY_BLOCK = 4096


@dataclass
class Books:
    """Codebooks (parts, BOOK, PART), and how many times parallel error outweighs orthogonal error."""

    dims: int
    words: np.ndarray
    price: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.words.shape[0] * PART - self.dims))).reshape(len(x), -1, PART).astype(np.float32)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """A code for each vector and part, by coordinate descent on |r|^2 + (price - 1) (r . u)^2, r the residual and u the direction."""
        x = self.parts(x)
        u = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-30)[:, None, None]
        gap = x[:, :, None, :] - self.words[None]  # vectors, parts, words, components
        square, along = (gap**2).sum(axis=3), (gap * u[:, :, None, :]).sum(axis=3)
        codes = square.argmin(axis=2)
        rows = np.arange(len(x))
        parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.words.shape[0]):
                rest = parallel - along[rows, m, codes[:, m]]
                codes[:, m] = (square[:, m] + (self.price - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                parallel = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two codes a byte; and how far each vector lies from what its codes stand for."""
        codes = self.encode(x)
        own = np.pad(x, ((0, 0), (0, self.words.shape[0] * PART - self.dims))).reshape(len(x), -1, PART)
        off = np.sqrt(((own - self.words[np.arange(self.words.shape[0]), codes]) ** 2).sum(axis=(1, 2)))
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] | codes[:, 1::2] << 4, off

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the inner products of its two codewords with the query: (bytes, 256, queries)."""
        of_words = np.einsum("qmd,mwd->mwq", self.parts(queries), self.words)
        of_words = np.pad(of_words, ((0, len(of_words) % 2), (0, 0), (0, 0)))
        return (of_words[1::2, :, None] + of_words[::2, None]).reshape(len(of_words) // 2, BOOK * BOOK, -1)


def fit(sample: np.ndarray, rounds: int = 4, seed: int = 2) -> Books:
    """Codebooks of a sample (n, dims): k-means for each part, then rounds of anisotropic assignment and the exact least-squares update of all books."""
    n, dims = sample.shape
    parts = -(-dims // PART)
    price = max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    books = Books(dims, np.zeros((parts, BOOK, PART), np.float32), price)
    if not n:
        return books
    x, draw = books.parts(sample), np.random.default_rng(seed)
    for m in range(parts):
        words = x[draw.choice(n, BOOK, replace=n < BOOK), m]
        for _ in range(10):
            code = ((x[:, m, None] - words[None]) ** 2).sum(axis=2).argmin(axis=1)
            count = np.bincount(code, minlength=BOOK)
            words = np.where(count[:, None] > 0, np.stack([np.bincount(code, x[:, m, d], BOOK) for d in range(PART)], axis=1) / np.maximum(count, 1)[:, None], words).astype(np.float32)
        books.words[m] = words
    u = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
    size = parts * BOOK * PART
    for _ in range(rounds):
        codes = books.encode(sample)
        place = (np.arange(parts) * BOOK + codes)[:, :, None] * PART + np.arange(PART)
        normal, right = np.zeros((size, size)), np.zeros(size)
        for at in range(0, n, 2048):
            spread = np.zeros((len(u[at : at + 2048]), size))
            np.put_along_axis(spread, place[at : at + 2048].reshape(len(spread), -1), u[at : at + 2048].reshape(len(spread), -1), 1)
            normal += (price - 1) * spread.T @ spread
            right += (price - 1) * spread.T @ (u[at : at + 2048] * x[at : at + 2048]).sum(axis=(1, 2))
        normal[np.diag_indices(size)] += np.bincount(place.ravel(), minlength=size) + 1e-6
        right += np.bincount(place.ravel(), x.ravel(), size) + 1e-6 * books.words.ravel()
        books.words = np.linalg.solve(normal, right).reshape(books.words.shape).astype(np.float32)
    return books


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows with a key and a vector that is neither null nor zero nor holds a null or non-finite component."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def _indexed(books: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            x = matrix(batch.column(1), books.dims)
            packed, off = books.packed(x)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array((x**2).sum(axis=1) / 2), pa.array(off)], ["id", "v", "codes", "half", "off"])

    return run


def build_index(rows: DataFrame, dims: int) -> tuple[DataFrame, Books]:
    """(id, v, codes, half, off): every vector with its packed codes, half its squared norm and its quantisation error, kept in the shared folder; and the codebooks."""
    n = rows.count()
    drawn = rows.where(hash_share(F.col("id"), 2) < min(1.0, SAMPLE / max(1, n))).orderBy("id", "v").select("v").toArrow()  # about SAMPLE rows
    books = fit(matrix(drawn.column("v").combine_chunks(), dims) if len(drawn) else np.zeros((0, dims)))
    return written(rows.mapInArrow(_indexed(books), "id bigint, v array<double>, codes binary, half double, off double")), books


def _scan(sent, k: int):
    """The k nearest of a partition's vectors to each query, found by codes and reranked by exact distance.

    The best RERANK by codes give a distance that the k-th nearest can't exceed. Then every vector is reranked that may
    be as near, by Cauchy and Schwarz: its approximate score is wrong by at most its quantisation error times the query's norm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, books = sent.value
        tables = books.tables(queries)
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in arrow_rows(batches, ROWS):
            order = np.argsort(np.asarray(batch.column("id")), kind="stable")
            at, x = np.asarray(batch.column("id"))[order], matrix(batch.column("v"), books.dims)[order]
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(at), -1)[order]
            exact_half, off = np.asarray(batch.column("half"))[order], np.asarray(batch.column("off"))[order]
            half, size = exact_half.astype(np.float32), np.sqrt(2 * exact_half)

            def rerank(q: int, some: np.ndarray) -> None:
                some = some[at[some] != ids[q]]
                far = np.sqrt(np.cumsum((x[some] - queries[q]) ** 2, axis=1)[:, -1])  # added in order, as a plain loop would
                d, i = np.concatenate([best[q][0], far]), np.concatenate([best[q][1], at[some]])
                first = np.lexsort((i, d))[:k]
                best[q] = d[first], i[first]

            for a in range(0, len(ids), 256):
                own = queries[a : a + 256]
                near = np.zeros((len(at), len(own)), np.float32)
                for j in range(codes.shape[1]):
                    near += tables[j, :, a : a + 256][codes[:, j]]
                near = (near - half[:, None]).T
                tried = [chosen(scores, RERANK) for scores in near]
                for q, some in enumerate(tried, a):
                    rerank(q, some)
                if len(at) <= RERANK:
                    continue
                norm = np.linalg.norm(own, axis=1)
                least = (norm**2 - np.array([best[q][0][-1] ** 2 if len(best[q][0]) == k else np.inf for q in range(a, a + len(own))])) / 2
                rounding = (codes.shape[1] + 8) * 2.0**-22  # of 32-bit sums
                may = ~(near + (norm[:, None] * (off + rounding * (size + off)) + rounding * exact_half) < least[:, None])  # so that what isn't a number may
                for row, some in zip(may, tried):
                    row[some] = False
                some = np.flatnonzero(may.any(axis=0))
                exact = own @ x[some].T - exact_half[some]
                may = may[:, some] & ~(exact + 1e-9 * (norm[:, None] * size[some] + exact_half[some] + norm[:, None] ** 2) < least[:, None])
                for q in np.flatnonzero(may.any(axis=1)).tolist():
                    rerank(a + q, some[may[q]])
        counts = [len(d) for d, _ in best]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([d for d, _ in best]))], ["query_id", "vec_id", "score"])

    return run


def chosen(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n best scores; of those that tie for the last places the first ones. No bound on what is found: see _scan."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    over, on = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([over, on[: n - len(over)]])


def nearest(df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows of df by Euclidean distance, nearest first, ties to the smaller id.

    A query's own id isn't found. Vectors that are null, zero, or hold a null or non-finite component
    take no part, nor do those of another length than most vectors have. Rows that repeat an id are
    all candidates; of queries that repeat one, the least vector is searched. Every vector is
    scanned, and all that may be among the k nearest are compared, so result and distances are exact. Queries travel in blocks of QUERY_BLOCK, a job for each.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    # One row a length.
    length = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    kind = "query_id bigint, vec_id bigint, score double"
    if length is None:
        return spark.createDataFrame([], f"{kind}").select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    index, books = build_index(rows.where(F.size("v") == length["dims"]), length["dims"])
    asked = usable(queries, key, vector).where(F.size("v") == length["dims"]).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toArrow()  # about QUERY_BLOCK rows
        ids = np.asarray(own.column("id").combine_chunks(), np.int64)
        sent = spark.sparkContext.broadcast((ids, matrix(own.column("v").combine_chunks(), length["dims"]), books))
        part = index.mapInArrow(_scan(sent, k), kind)
        found.append(part if blocks == 1 else written(part))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors to every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum([x * x for x in embedding]) > 0),
far AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i]) for i in range(1, len(q.e) + 1)])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM far) WHERE rank <= 10
"""
