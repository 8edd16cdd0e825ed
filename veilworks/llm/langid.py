"""Language identification: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, hash_share, remainder, small_batches, table
from veilworks.llm.letters import BLOCK, Letters, Table, blocks

#: Documents of a language to learn from, about; the sample depends on doc_id only. Texts longer than SAMPLE_CHARS aren't drawn.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 200_000
#: Words, and n-grams of each length, that a language's model holds at most; all languages together hold ALL_ENTRIES.
WORDS, GRAMS, ALL_ENTRIES = 20_000, 8_000, 1_200_000
LONGEST = 5
#: Log probability of a language that one word can give at least, and words whose evidence counts in full.
WORST = -7.0
FULL_WORDS = 20
UNDETERMINED = "und"


def normalised(log: np.ndarray) -> np.ndarray:
    """Rows of log likelihoods as log posteriors under equal priors, not below WORST."""
    return np.maximum(log - np.logaddexp.reduce(log, axis=1, keepdims=True), WORST)


@dataclass
class Model:
    """languages; hashes of words (size 0) and n-grams (size n), and for each the log posterior of the languages, had all as much text."""

    languages: list[str] = field(default_factory=list)
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, Table] | None = None

    def found(self, size: int, hashes: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.tables = {k: Table(v) for k, v in self.keys.items()}
        return self.tables[size].find(hashes) if size in self.tables else np.full(len(hashes), -1, np.int32)

    def evidence(self, letters: Letters) -> np.ndarray:
        """A row for each word: log posteriors of the languages, then 1; zeros for a word of which nothing is known.

        A known word gives its own row. Of others, the longest n-grams of which any is known give the mean of their rows.
        """
        out = np.zeros((len(letters.starts), len(self.languages) + 1))
        known = self.found(0, letters.hashes(letters.starts, letters.ends))
        out[known >= 0, :-1] = self.rows[0][known[known >= 0]] if 0 in self.rows else 0
        out[known >= 0, -1] = 1
        unseen = np.flatnonzero(known < 0)
        for n in range(LONGEST, 0, -1):
            if not len(unseen):
                break
            hashes, owner = letters.grams(unseen, n)
            at = self.found(n, hashes)
            owner, at = owner[at >= 0], at[at >= 0]
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            word = owner[first]
            mean = np.add.reduceat(self.rows[n][at], first, axis=0, dtype=np.float64) / np.diff(np.append(first, len(at)))[:, None]
            out[unseen[word], :-1] = normalised(mean)
            out[unseen[word], -1] = 1
            unseen = np.delete(unseen, word)
        return out

    def identify(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each whole text the number of its language, or -1 if it has no letter (or no language was learned), and the probability."""
        many = len(self.languages)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not many:
            return best, score
        total, lettered = np.zeros((len(texts), many + 1)), np.zeros(len(texts), bool)
        for whose, parts in blocks(texts, max(4096, min(BLOCK, 8 * BLOCK // many))):
            letters = Letters(parts)
            text = np.array(whose)[letters.text]
            lettered[text] = True
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[first]] += np.add.reduceat(self.evidence(letters), first, axis=0)
        n = total[:, -1:]
        log = total[:, :-1] / np.maximum(n, 1) * np.minimum(n, FULL_WORDS)
        best[lettered] = np.argmax(log, axis=1)[lettered]
        score[lettered] = np.exp(log.max(axis=1) - np.logaddexp.reduce(log, axis=1))[lettered]
        return best, score


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word and n-gram occurs in the rows of a language, by hash."""
    for batch in arrow_rows(batches, 512):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, parts in blocks([t for x, t in zip(langs, texts) if x == lang], 1 << 20):
                letters = Letters(parts)
                for size in range(LONGEST + 1):
                    hashes = letters.grams(np.arange(len(letters.starts)), size)[0] if size else letters.hashes(letters.starts, letters.ends)
                    keys, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "size", "item", "n"])


def train(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from df's labelled rows.

    About sample_docs rows of each language are drawn by a hash of the key. Rows whose text or
    language is null, and texts of more than SAMPLE_CHARS, are left out. A table without rows gives
    a model that knows no language.
    """
    rows = small_batches(df).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # One row a language.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))])
    drawn = rows.where((hash_share(F.coalesce(F.col("key").cast("string"), F.lit("")), 1) < F.element_at(share, F.col("lang"))) & (F.length("text") <= SAMPLE_CHARS)).select("lang", "text")
    by = ("lang", "size", "item")
    counted = drawn.mapInArrow(_counts, "lang string, size int, item bigint, n bigint").groupBy(*by).agg(F.sum("n").alias("n"))
    fair = ALL_ENTRIES // (len(languages) * (LONGEST + 1))
    most = F.when(F.col("size") == 0, F.lit(min(WORDS, fair))).otherwise(F.lit(min(GRAMS, fair)))
    frequent = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    kept = counted.where("n > 1").withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= most)
    found = kept.select(*by, "n").toArrow()  # ALL_ENTRIES rows at most
    model = Model(languages)
    place = {x: i for i, x in enumerate(languages)}
    lang_at, size_at = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64), found.column("size").to_numpy()
    item_at, n_at = found.column("item").to_numpy().view(np.uint64), found.column("n").to_numpy()
    for size in range(LONGEST + 1):
        own = size_at == size
        keys, at = np.unique(item_at[own], return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        counts[at, lang_at[own]] = n_at[own]
        model.keys[size] = keys
        model.rows[size] = normalised(np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))).astype(np.float32) if len(keys) else counts.astype(np.float32)
    return model


def predict(df: DataFrame, model: Model, *, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each row's whole text, and its probability.

    A null text, or one without a letter, is `und` with probability 0. Ties go to the language first
    in the alphabet. Columns of those names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def run(column: pa.Array) -> pa.Array:
        names = np.array([*sent.value.languages, UNDETERMINED], object)
        langs, scores = [np.array([], object)], [np.array([])]
        for at in range(0, len(column), 1024):
            best, found = sent.value.identify(column.slice(at, 1024).to_pylist())
            langs.append(names[best])
            scores.append(found)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    return small_batches(df).withColumn("__said", run(text)).withColumns({out: F.col("__said.lang"), score: F.col("__said.score")}).drop("__said")


def op1_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


#: Least probability of a document's language for it to stay in the pipeline.
LEAST_SCORE = 0.5


def keep_identified(df: DataFrame, *, lang: str = "lang", least_score: float = LEAST_SCORE) -> DataFrame:
    """df without the rows whose language can't be told: no letter, or a best language below least_score. Learns from df's own labels; columns stay."""
    own = df.columns
    judged = predict(df, train(df, lang=lang), out="__lang", score="__score")
    return judged.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least_score)).select(*own)
