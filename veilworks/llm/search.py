"""Ranked lexical search by Fagin's threshold algorithm: lists sorted by impact are read in turn, what they name is looked up in a forward index, until nothing unread can be among the best."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import cut, small_batches, table, written

K = 20
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
#: In UTF-8 a term is a run of ASCII letters, lower-cased, digits, and bytes from 0x80 on; all else becomes a blank.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: If all items together have no more terms than this, only these are indexed; else every term is. The answer is the same.
KNOWN_TERMS = 500_000
#: Terms of the items that are asked for at a time; each block is one job over the index.
BLOCK_TERMS = 200_000
#: Documents and postings of a task that are searched at a time.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Places of each list read in the first round; as many again in all rounds before in each later one.
FIRST_PLACES = 32
INDEX = "doc_id long, n long, terms array<string>, tf array<long>"
#: Ranks after every other doc_id, for rows without one.
NO_ID = (1 << 63) - 1


def term_counts(text: str | None) -> Counter:
    """The terms of a text as UTF-8, and how often each comes."""
    data, at, found = (text or "").encode("utf-8", "replace").translate(WORDS), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _indexed(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known else None
        for batch in batches:
            n, sizes, terms, tf = [], [0], [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text)
                held = list(counts) if wanted is None else [t for t in counts if t in wanted]
                n.append(counts.total())
                terms += held
                tf += [counts[t] for t in held]
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return run


def forward(docs: DataFrame, known=None) -> DataFrame:
    """(doc_id, n, terms, tf) of every text: the number of its terms, its distinct terms (of `known`, a broadcast set of UTF-8 terms, if given) and how often each comes."""
    return small_batches(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")).mapInArrow(_indexed(known), INDEX)


class Shard:
    """A bounded number of documents: by document its postings, and by term its list, the highest impact first."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_terms: int):
        self.docs, self.terms, self.impact = docs, terms, impact
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        holder = np.repeat(np.arange(len(docs)), sizes)
        order = np.lexsort((docs[holder], -impact, terms))
        self.list_at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.list_doc, self.list_impact = holder[order], impact[order]

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The whole scores of documents, looked up in the forward index. weights: by term. Each document holds a term at least."""
        sizes = self.at[rows + 1] - self.at[rows]
        first = np.cumsum(sizes) - sizes
        where = np.repeat(self.at[rows] - first, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(weights[self.terms[where]] * self.impact[where], first)

    def best(self, terms: np.ndarray, weight: np.ndarray, weights: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, doc_id) of `found` and this shard for an item: its terms, each one's weight, and `weights` by term."""
        start, end = self.list_at[terms], self.list_at[terms + 1]
        seen, place, step = np.zeros(len(self.docs), bool), start.copy(), FIRST_PLACES
        score, doc = found
        while True:
            upto = np.minimum(place + step, end)
            new = np.unique(np.concatenate([self.list_doc[a:b] for a, b in zip(place, upto) if a < b] or [np.zeros(0, np.int64)]))
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                score, doc = np.concatenate([score, self.scores(new, weights)]), np.concatenate([doc, self.docs[new]])
                order = np.lexsort((doc, -score))[:k]
                score, doc = score[order], doc[order]
            place, unread = upto, upto < end
            # No document that is in none of the places read can score more than this.
            threshold = int((weight[unread] * self.list_impact[place[unread]]).sum())
            if not unread.any() or (len(score) == k and threshold < score[-1]):
                return score, doc
            step = int((place - start).max())


def _searched(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, at, terms, weight, vocabulary, n_docs, n_terms = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        held: list[tuple[np.ndarray, ...]] = []

        def search() -> None:
            docs, sizes, own, impact = (np.concatenate(x) for x in zip(*held))
            shard, weights = Shard(docs, sizes, own, impact, len(vocabulary)), np.zeros(len(vocabulary), np.int64)
            for i in range(len(items)):
                mine = slice(at[i], at[i + 1])
                weights[terms[mine]] = weight[mine]
                best[i] = shard.best(terms[mine], weight[mine], weights, best[i], k)
                weights[terms[mine]] = 0

        for batch in batches:
            for piece in (batch.slice(i, SHARD_DOCS // 4) for i in range(0, batch.num_rows, SHARD_DOCS // 4)):
                lists, tf = piece.column("terms"), np.asarray(piece.column("tf").flatten(), np.int64)
                sizes = np.asarray(pc.list_value_length(lists), np.int64)
                number = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1), np.int64)
                holder, mine = np.repeat(np.arange(len(sizes)), sizes), number >= 0
                length = np.asarray(piece.column("n"), np.int64)
                m = 100 - 25 + (25 * length * n_docs) // max(n_terms, 1)
                impact = (1_000_000_000 * tf[mine]) // (1000 * tf[mine] + 12 * m[holder[mine]])
                count = np.bincount(holder[mine], minlength=len(sizes))
                there = count > 0
                held.append((np.asarray(piece.column("doc_id"), np.int64)[there], count[there], number[mine], impact))
                if sum(len(x[0]) for x in held) >= SHARD_DOCS or sum(len(x[2]) for x in held) >= SHARD_POSTINGS:
                    search()
                    held.clear()
        if held:
            search()
        n = [len(s) for s, _ in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items, n)), pa.array(np.concatenate([d for _, d in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text), scores above 0 only, equal ones by doc_id.

    Every row of items is an item of its own, also where ids repeat or are null; every row of docs is
    a document, those without an id rank last among equals. Null texts, and items or documents without
    terms, find nothing and are not found; nor is anything where either table is empty. Other columns
    are left alone. All texts are read whole.

    Texts are read once, into a forward index of the terms that items ask for (of every term, if the
    items have more than KNOWN_TERMS), kept in the shared folder. Each task then turns its documents, a
    bounded shard at a time, into lists by impact, and runs the threshold algorithm for every item of
    a block; what it has found in earlier shards lets it stop sooner in later ones. k rows for each
    item and task meet at the end. No list, word or source is gathered anywhere as a whole.
    """
    spark = docs.sparkSession
    # Numbers are drawn once, so the kept table holds them: drawn again over other partitions they would name other items.
    rows = cut(items.select(F.col("item_id"), "text").withColumn("item", F.monotonically_increasing_id()))
    asked = cut(forward(rows.select(F.col("item").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item").join(rows.select("item", "item_id"), "item"))
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    few = vocabulary.count() <= KNOWN_TERMS
    known = spark.sparkContext.broadcast(frozenset(t.encode() for t in vocabulary.toArrow().column("term").to_pylist())) if few else None
    index = written(forward(docs, known).where("n > 0"))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found_in = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = asked.select("item", "item_id", F.explode(F.arrays_zip("terms", "tf")).alias("z")).select("item", "item_id", F.col("z.terms").alias("term"), F.col("z.tf").alias("repeats"))
    weight = F.floor(F.lit(1000.0) * F.ln((2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    wanted = cut(each.join(found_in, "term").withColumn("weight", weight * F.col("repeats")).where("weight > 0"))
    blocks, found = -(-wanted.count() // BLOCK_TERMS), []
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "term", "weight").orderBy("item").toArrow()  # about BLOCK_TERMS rows
        item, at = np.unique(np.asarray(own.column("item").combine_chunks(), np.int64), return_index=True)
        words = pc.unique(own.column("term").combine_chunks())
        number = np.asarray(pc.index_in(own.column("term").combine_chunks(), value_set=words), np.int64)
        sent = spark.sparkContext.broadcast((item, np.append(at, own.num_rows), number, np.asarray(own.column("weight").combine_chunks(), np.int64), words, n_docs, n_terms))
        part = index.mapInArrow(_searched(sent, k), "item long, doc_id long, score long")
        found.append(part if blocks == 1 else written(part))
    none = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found, none).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
long AS (SELECT doc_id, d, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM long),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
items AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, i, l.doc_id, l.d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN long l USING (d), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
