"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, by_length, cut, hash_share, remainder, small_batches, table
from veilworks.llm.letters import BASE, Letters, Table, blocks

#: Labelled documents of each class to fit on, about (toxic, clean); the sample depends on doc_id only. Texts longer than SAMPLE_CHARS aren't drawn, but counted.
SAMPLE_DOCS = (500, 1500)
SAMPLE_CHARS = 20_000
#: Documents of each class, the first ones of the sample by the hash, on whose tokens the field itself is fitted; the rest of it weigh the aggregates.
FIELD_DOCS = 250
#: Labelled documents up to so many are broadcast as keys.
BROADCAST_KEYS = 200_000
#: A word or prefix marks a token of a toxic document as toxic if it occurs so many times as often in a labelled toxic document as in a clean one,
#: and if chance would share out the documents that hold it so with a log probability of -MARK_NATS at most.
MARK_ODDS, MARK_NATS = 20.0, 12.0
#: Features of a token: the whole word, and its first n letters.
PREFIXES = (3, 4, 5, 6)
#: Features that the field knows at most.
FEATURES = 50_000
STEPS, RATE, DECAY = 40, 0.2, 1.0
REJECT = 0.7
SPAN = 0.5
#: Tokens of which one that is toxic counts as many.
SHARE = 20.0
AGGREGATES = 4


@dataclass
class Chains:
    """Sequences laid out by position: all first tokens, all second ones and so on, the longest sequence first."""

    order: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max(initial=0))
        counts = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        begins = np.cumsum(counts) - counts
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return cls(order, begins[at] + np.repeat(rank, lengths) if len(at) else at, counts, begins)


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains with the states clean (0) and toxic (1).

    emission: how much likelier each token's own features make toxic, in log; moves: 2 x 2 weights, not
    logs. Returns the probability that each token is toxic, and, if asked to
    count, the expected number of each move.
    """
    chains = Chains.of(lengths)
    e = np.empty(len(emission))
    e[chains.place] = np.exp(np.clip(emission, -30, 30))
    forward, backward, pairs = np.empty(len(e)), np.empty(len(e)), np.zeros((2, 2))
    for t, (n, b) in enumerate(zip(chains.counts.tolist(), chains.begins.tolist())):
        if t:
            f = forward[chains.begins[t - 1] : chains.begins[t - 1] + n]
            clean, toxic = (1 - f) * moves[0, 0] + f * moves[1, 0], ((1 - f) * moves[0, 1] + f * moves[1, 1]) * e[b : b + n]
        else:
            clean, toxic = moves[0, 0], moves[0, 1] * e[b : b + n]
        forward[b : b + n] = toxic / (clean + toxic)
    for t in range(len(chains.counts) - 1, -1, -1):
        n, b = int(chains.counts[t]), int(chains.begins[t])
        backward[b : b + n] = 0.5
        if t + 1 < len(chains.counts):
            m, c = int(chains.counts[t + 1]), int(chains.begins[t + 1])
            r, f = backward[c : c + m], forward[b : b + m]
            to_clean, to_toxic = 1 - r, r * e[c : c + m]
            clean, toxic = moves[0, 0] * to_clean + moves[0, 1] * to_toxic, moves[1, 0] * to_clean + moves[1, 1] * to_toxic
            backward[b : b + m] = toxic / (clean + toxic)
            if not count:
                continue
            whole = (1 - f) * clean + f * toxic
            both = np.array([[(1 - f) * moves[0, 0] * to_clean, (1 - f) * moves[0, 1] * to_toxic], [f * moves[1, 0] * to_clean, f * moves[1, 1] * to_toxic]])
            pairs += (both / whole).sum(axis=2)
    toxic, clean = forward * backward, (1 - forward) * (1 - backward)
    return (toxic / (toxic + clean))[chains.place], pairs


def token_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By blocks, the text that each token is of, and a hash for each of its features: the word, then prefixes (0 where the word is no longer)."""
    for text, parts in blocks(texts):
        letters = Letters(parts)
        found = np.zeros((1 + len(PREFIXES), len(letters.starts)), np.uint64)
        found[0] = letters.hashes(letters.starts, letters.ends) ^ np.uint64(0x5BD1E995)
        for k, n in enumerate(PREFIXES, 1):
            long = letters.ends - letters.starts >= n
            found[k, long] = letters.hashes(letters.starts[long], letters.starts[long] + n)
        yield np.array(text)[letters.text], found


@dataclass
class Model:
    """Feature weights by hash, weights of moves, and the logistic weights of a document's aggregates."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scale: np.ndarray
    table: Table | None = None

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The text that each token is of, and the probability that it is toxic."""
        if self.table is None:
            self.table = Table(self.keys)
        text, emission = [np.zeros(0, np.int64)], [np.zeros(0)]
        for whose, hashes in token_features(texts):
            text.append(whose)
            emission.append(self.emission(hashes))
        text = np.concatenate(text)
        return text, marginals(np.concatenate(emission), np.bincount(text, minlength=len(texts)), self.moves)[0]

    def emission(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape[1], self.bias)
        for column in hashes:
            row = self.table.find(column)
            out[row >= 0] += self.weights[row[row >= 0]]
        return out

    def scores(self, text: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregates(text, toxic, n) @ self.scale, -30, 30)))


def aggregates(text: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts 1; and in logs the evidence that any token is toxic (noisy or), the expected number of toxic tokens among those that are likelier toxic than clean, and that number's share of the text."""
    hot = toxic >= SPAN
    evidence = np.bincount(text[hot], -np.log1p(-np.minimum(toxic[hot], 1 - 1e-9)), n)
    count = np.bincount(text[hot], toxic[hot], n)
    return np.stack([np.ones(n), np.log1p(evidence), np.log1p(count), np.log1p(count / (SHARE + np.bincount(text, minlength=n) / SHARE))], axis=1)


def gathered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """token_features of all texts in one."""
    found = list(token_features(texts))
    return np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)]), np.concatenate([np.zeros((1 + len(PREFIXES), 0), np.uint64), *(h for _, h in found)], axis=1)


def fit(texts: list[str], labels: np.ndarray, marks: np.ndarray, field_docs: int = FIELD_DOCS) -> Model:
    """A model of labelled texts, in an order that says nothing, and of the features that mark (marking_features).

    The labels are of documents. Tokens get theirs from what tells the documents apart: a token of a
    toxic document is toxic if its word or a prefix of it marks; all others are clean. What marks has a
    weight in common, so that it counts where these texts lack it, besides those of the features of
    the first field_docs texts of each class. Of texts that look like copies of one another one is used, or
    the chance words of a copied text would pass for toxic. Without texts of both classes every score is one half.
    """
    text, hashes = gathered(texts)
    one = first_of_copies(text, hashes[0], labels)
    if not one.all():
        del text, hashes
        return fit([t for t, k in zip(texts, one) if k], labels[one], marks, field_docs)
    n_toxic, n_clean = int(labels.sum()), int(len(labels) - labels.sum())
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.ones((2, 2)), np.zeros(AGGREGATES))
    toxic_ids, clean_ids = (np.flatnonzero(labels == k)[:field_docs] for k in (1, 0))
    chosen = np.isin(text, np.concatenate([toxic_ids, clean_ids]))
    own, lengths = hashes[:, chosen], np.bincount(text[chosen], minlength=len(texts))
    lengths, doc = lengths[lengths > 0], text[chosen]
    names = np.unique(own[own != 0])  # others would keep the weight 0
    lookup, pairs = Table(names), np.zeros(0, np.int64)
    for column in hashes:
        at = lookup.find(column)
        pairs = np.union1d(pairs, at[at >= 0].astype(np.int64) * len(texts) + text[at >= 0])
    common = np.bincount(pairs // len(texts), minlength=len(names))
    kept = np.lexsort((names, -common))[:FEATURES]
    kept = kept[(common[kept] >= 5) & (names[kept] != 0)]
    keys = np.union1d(names[kept], marks)
    free = np.isin(keys, names[kept])
    marking, lookup = Table(marks), Table(keys)
    marked = sum((marking.find(c) >= 0).astype(np.float64) for c in own)
    truth = (labels[doc] == 1) & (marked > 0)
    rows = np.stack([lookup.find(c) for c in own])
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[follows].astype(int), truth[follows + 1].astype(int)), 1)
    weights, shared, bias, log_moves = np.zeros(len(keys) + 1), 0.0, -2.0, np.zeros((2, 2))
    size, moment, square = max(1, len(truth)), np.zeros(len(keys) + 7), np.zeros(len(keys) + 7)
    for step in range(1, STEPS + 1):
        emission = weights[rows].sum(axis=0) + shared * marked + bias  # row -1 is the last weight, which stays 0
        toxic, pairs = marginals(emission, lengths, np.exp(log_moves), count=True)
        miss = truth - toxic
        slope = np.append(sum(np.bincount(r[r >= 0], miss[r >= 0], len(keys)) for r in rows) * free, 0.0)
        gradient = np.concatenate([slope - DECAY * weights, [miss.sum()], (seen - pairs).ravel(), [miss @ marked - DECAY * shared]]) / size
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, bias, log_moves, shared = weights + change[: len(keys) + 1], bias + change[len(keys) + 1], log_moves + change[len(keys) + 2 : -1].reshape(2, 2), shared + change[-1]
        weights[-1] = 0
        log_moves[0, 0] = 0
    model = Model(keys, weights[:-1] + shared * np.isin(keys, marks), float(bias), np.exp(log_moves), np.zeros(AGGREGATES), lookup)
    toxic, _ = marginals(model.emission(hashes), np.bincount(text, minlength=len(texts)), model.moves)
    unseen = np.ones(len(texts), bool)
    unseen[np.concatenate([toxic_ids, clean_ids])] = False
    if min(labels[unseen].sum(), (1 - labels[unseen]).sum()) < 20:  # too few to weigh the aggregates by texts that the field hasn't seen
        unseen[:] = True
    model.scale = logistic(aggregates(text, toxic, len(texts))[unseen], labels[unseen])
    model.table = None
    return model


def first_of_copies(text: np.ndarray, word: np.ndarray, labels: np.ndarray, draws: int = 4) -> np.ndarray:
    """Which texts share none of their `draws` least hashes of three words with an earlier text of the same label."""
    first = np.ones(len(labels), bool)
    whose, least = least_threes(text, word, draws)
    for values in least if len(whose) else ():
        _, at = np.unique(np.stack([values, labels[whose].astype(np.uint64)]), axis=1, return_index=True)
        again = np.ones(len(whose), bool)
        again[at] = False
        first[whose[again]] = False
    return first


def least_threes(text: np.ndarray, word: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have three words, and `draws` least hashes of three words of each."""
    inside = np.flatnonzero(text[2:] == text[:-2])
    three, whose = word[inside] * np.uint64(31) + word[inside + 1] * np.uint64(17) + word[inside + 2], text[inside]
    begins = np.flatnonzero(np.diff(whose, prepend=-1))
    least = np.zeros((draws, len(begins)), np.uint64)
    for draw in range(draws if len(begins) else 0):
        mixed = (three ^ (three >> np.uint64(31))) * (BASE + np.uint64(2 * draw))
        least[draw] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), begins)
    return whose[begins], least


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method, both classes weighing alike, the weights but for the first drawn towards 0."""
    w, hold = np.zeros(x.shape[1]), decay * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-9))[:, None]) + hold, x.T @ (weight * (y - p)) - hold @ w)
    return w


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, 512):
        text, hashes = gathered(batch.column("__text").to_pylist())
        whose, least = least_threes(text, hashes[0], DRAWS)
        found: list = [[]] * batch.num_rows
        for i, values in zip(whose.tolist(), least.view(np.int64).T.tolist()):
            found[i] = values
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("__key", "__code", "__label")), pa.array(found, pa.list_(pa.int64()))], ["__key", "__code", "__label", "least"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches):
        n = batch.num_rows
        text, hashes = gathered(batch.column("__text").to_pylist())
        names, at = np.unique(hashes.ravel(), return_inverse=True)
        pairs, times = np.unique(at.ravel() * n + np.tile(text, len(hashes)), return_counts=True)
        at, doc = pairs // max(n, 1), pairs % max(n, 1)
        share, toxic = batch.column("share").to_numpy()[doc], batch.column("__label").to_numpy()[doc] == 1
        sums = [pa.array(np.bincount(at, share * own * by, len(names))) for by in (1, times) for own in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *sums], ["feature", "toxic", "clean", "toxic_times", "clean_times"])


#: Least hashes by which copies are told.
DRAWS = 4


def marking_features(rows: DataFrame) -> np.ndarray:
    """The features that mark, of all rows (__key, __text, __label).

    Of texts of one label that share one of DRAWS least hashes of three words the one of the least key
    counts; a row that is there n times counts for one nth each time. Counts are summed in Spark; only
    the features that mark, eight bytes each, come to the driver.
    """
    rows = rows.withColumn("__code", F.xxhash64("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    seen = rows.select("__key", "__code", "__label", "__text").mapInArrow(_least, f"__key {kind}, __code bigint, __label int, least array<bigint>")
    seen = cut(seen.groupBy("__key", "__code").agg(F.max("__label").alias("__label"), F.max("least").alias("least"), (1 / F.count(F.lit(1))).alias("share")))
    leads = seen.select("__key", "__code", "__label", F.posexplode("least").alias("draw", "hash")).groupBy("draw", "hash", "__label").agg(F.min(F.struct("__key", "__code")).alias("first"))
    leads = leads.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == DRAWS).select("first.*")  # first in each of its groups
    own = seen.select("__key", "__code", "__label", "share")
    kept = cut(own.join(leads, ["__key", "__code"], "left_semi").unionByName(seen.where(F.size("least") == 0).select(*own.columns)))
    docs = {r["__label"]: r["n"] for r in kept.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = docs.get(1, 0), docs.get(0, 0)
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64)
    drawn = kept.select("__key", "__code", "share")
    counted = rows.join(F.broadcast(drawn) if n_toxic + n_clean <= BROADCAST_KEYS else drawn, ["__key", "__code"]).select("__text", "__label", "share").mapInArrow(_counted, "feature bigint, toxic double, clean double, toxic_times double, clean_times double")
    counted = counted.where("feature <> 0").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_times", "clean_times")))
    toxic, clean, prior = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    odds = (F.col("toxic_times") + 0.5) / (n_toxic + 1) / ((F.col("clean_times") + 0.5) / (n_clean + 1))
    nats = toxic * F.log(toxic / (toxic + clean) / prior + 1e-300) + clean * F.log(clean / (toxic + clean) / (1 - prior) + 1e-300)
    found = counted.where((odds >= MARK_ODDS) & (nats >= MARK_NATS)).select("feature").toArrow().column("feature")
    return np.sort(np.asarray(found.to_numpy(), np.int64).view(np.uint64))


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: tuple[int, int] = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS, field_docs: int = FIELD_DOCS,
) -> Model:
    """A model of the rows of docs that labels (key, label) marks 1 or 0.

    What marks a token as toxic is counted over all of them. About sample_docs rows of each class are
    drawn by a hash of the key to fit the model, in a task that so holds a bounded number of texts; on
    the first field_docs of each class by that hash the field is fitted. A key that is labelled more than
    once counts as toxic if any label says so. Null keys, labels and texts are left out, and texts of
    more than sample_chars aren't drawn. The driver receives the model only.
    """
    marked = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__key").isNotNull() & F.col("__label").isin(0, 1)).groupBy("__key").agg(F.max("__label").alias("__label"))
    marked = cut(marked)
    counts = {r["__label"]: r["n"] for r in marked.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, sample_docs[1 - k] / max(1, counts.get(k, 0))) for k in (0, 1)}
    at = hash_share(F.col("__key").cast("string"), 10)
    drawn = marked.where(at < F.when(F.col("__label") == 1, share[1]).otherwise(share[0])).withColumn("__at", at)
    texts = small_batches(docs).select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    few = sum(counts.values()) <= BROADCAST_KEYS
    marks = marking_features(texts.join(F.broadcast(marked) if few else marked, "__key")) if len(counts) == 2 else np.zeros(0, np.uint64)
    # About sum(sample_docs) rows, whatever the tables' sizes.
    rows = texts.where(F.length("__text") <= sample_chars).join(F.broadcast(drawn), "__key")
    found = rows.select("__at", "__key", "__label", "__text").repartition(1).mapInArrow(_fitted(marks, field_docs), "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0, np.int64), marks)


def _fitted(marks: np.ndarray, field_docs: int):
    """The model of a task's rows, all of the sample, as bytes: fitted by an executor, so that the driver holds no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).sort_by([("__at", "ascending"), ("__key", "ascending"), ("__text", "ascending")])
            model = fit(rows.column("__text").to_pylist(), rows.column("__label").to_numpy().astype(np.int64), marks, field_docs)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def score(df: DataFrame, model: Model, *, text: str = "text", out: str = "score", spans: str = "spans") -> DataFrame:
    """df with the score of each row's whole text (0 to 1), and its toxic spans: array of (start, end, probability), in code points.

    A null text scores as an empty one, and has no spans. Columns of those names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    @F.arrow_udf("score double, spans array<struct<start int, end int, probability double>>")
    def run(column: pa.Array) -> pa.Array:
        scores, found = np.zeros(len(column)), [[] for _ in range(len(column))]
        for places, texts in by_length(column):
            whose, toxic = sent.value.tag(texts)
            scores[places] = sent.value.scores(whose, toxic, len(texts))
            ends = np.cumsum(np.bincount(whose, minlength=len(texts)))
            for i in np.unique(whose[toxic >= SPAN]).tolist():
                found[places[i]] = spans_of(texts[i], toxic[ends[i - 1] if i else 0 : ends[i]])
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(found, kind)], ["score", "spans"])

    return small_batches(df).withColumn("__said", run(text)).withColumns({out: F.col("__said.score"), spans: F.col("__said.spans")}).drop("__said")


def spans_of(text: str, toxic: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens that are toxic with a probability of SPAN or more."""
    starts, ends, at = [], [], 0
    for _, (part,) in blocks([text]):
        letters = Letters([part])
        starts.append(letters.starts - 1 + at)
        ends.append(letters.ends - 1 + at)
        at += len(part)
    start, end, over = np.concatenate(starts), np.concatenate(ends), np.concatenate([[False], toxic >= SPAN, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    return [{"start": int(start[a]), "end": int(end[b - 1]), "probability": float(toxic[a:b].max())} for a, b in zip(edges[::2], edges[1::2])]


def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the two folds of labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs, table(spark, sf_dir, "labels").where(~F.coalesce(held_out, F.lit(False))))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "spans")


def keep_clean(df: DataFrame, labels: DataFrame, *, reject: float = REJECT) -> DataFrame:
    """df without the rows whose score is `reject` or more; columns stay. Learns from all rows of df that labels marks."""
    own = df.columns
    return score(df, train(df, labels), out="__score", spans="__spans").where(F.col("__score") < reject).select(*own)
