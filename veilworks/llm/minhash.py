"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, cut, number_rows, small_batches, table, written
from veilworks.llm.graph import components

#: Hash functions; each gives a minimum and a maximum.
PERMUTATIONS = 64
#: Permutations in a band, which so holds twice as many values. 32 bands of 4 values miss a pair of similarity 0.8 about once in 20 million.
IN_BAND = 2
BANDS = PERMUTATIONS // IN_BAND
#: Ids of up to so many documents are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents and shingles that a block of a group holds, about.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 400_000
#: Members of a pivot's group that are compared with it together; of a larger group, parts are dealt over tasks.
PIVOT_ROWS = 256
#: Bytes of text that are hashed together.
TOGETHER = 1 << 18
#: Shingles that are permuted together.
PERMUTED = 1 << 13

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two independent hashes, by their first states: signatures are of the one, links are confirmed by the other.
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
#: Bytes up to which a word is hashed along with the others.
SHORT_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(said: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of the bytes of each word, eight at a time; of those that are longer than SHORT_WORD, BLAKE2."""
    eights = np.ndarray((len(said) + 1,), "<u8", np.append(said, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    size = ends - starts
    out = _mixed(size.astype(np.uint64) + seed)
    left = np.flatnonzero(size <= SHORT_WORD)
    at = 0
    while len(left):
        rest = size[left] - at
        lane = eights[starts[left] + at] & _FIRST_BYTES[np.minimum(rest, 8)]
        out[left] = _mixed((out[left] ^ lane) * np.uint64(0xFF51AFD7ED558CCD) + seed)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(said[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(seed).to_bytes(8, "big")).digest(), "big")
    return out


def shingle_sets(texts: list[str | None], width: int, seed: np.uint64 = SEEDS[0]) -> tuple[list[np.ndarray], list[int]]:
    """For each text the ascending distinct 64-bit hashes of its runs of `width` words; of the whole sequence if it has fewer words; none without words. And the sum of the hashes of its runs, repeated ones too."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    said = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[said]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    words = word_hashes(said, starts, ends, seed)
    firsts = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raw]))
    run = np.full(max(0, len(words) - width + 1), np.uint64(width) ^ seed)
    for k in range(width):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(run)])
    out, sums = [], []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= width:
            own = run[a : b - width + 1]
        else:
            own = np.full(min(1, b - a), np.uint64(b - a) ^ seed)
            for w in words[a:b]:
                own = _mixed(own * np.uint64(0x9E3779B97F4A7C15) + w)
        out.append(np.unique(own))
        sums.append(int(own.sum(dtype=np.uint64)))
    return out, sums


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(5)
    return draw.integers(0, 1 << 63, (PERMUTATIONS, 1), np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, (PERMUTATIONS, 1), np.uint64)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS rows of (minimum, maximum) of a set that isn't empty, with one evaluation a permutation and shingle."""
    times, plus = _functions()
    least, most = None, None
    for at in range(0, len(hashes), PERMUTED):
        values = hashes[at : at + PERMUTED] * times + plus
        low, high = values.min(axis=1), values.max(axis=1)
        least, most = (low, high) if least is None else (np.minimum(least, low), np.maximum(most, high))
    return np.stack([least, most], axis=1)


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of the signature: of IN_BAND minima and as many maxima, and the band's number."""
    rows = signature.reshape(BANDS, 2 * IN_BAND)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def _together(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """Rows [a, b) of a batch of (id, text), about TOGETHER bytes at a time."""
    texts = batch.column(1)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    a, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and held + n > TOGETHER:
            yield a, i, texts.slice(a, i - a).to_pylist()
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes), texts.slice(a).to_pylist()


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            for a, b, texts in _together(batch):
                sets, _ = shingle_sets(texts, width)
                _, sums = shingle_sets(texts, width, SEEDS[1])
                digest = [hashlib.blake2b(s.tobytes() + n.to_bytes(8, "big"), digest_size=16).digest() if len(s) else None for s, n in zip(sets, sums)]
                banded = [bands(min_max(s)).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], ["id", "n", "digest", "bands"])

    return run


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            for a, b, texts in _together(batch):
                sets, _ = shingle_sets(texts, width, SEEDS[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "hashes"])

    return run


def alike(shared, n_a, n_b, percent: int):
    """Whether sets of n_a and n_b members that share so many reach the similarity; of columns or numbers."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def _blocked(percent: int):
    """Links between members of two blocks of a group, as many as join what they join."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        ids, comps, far, sets = (rows[c].to_list() for c in ("id", "component", "far", "hashes"))
        at = [np.flatnonzero(rows["block"].to_numpy() == x) for x in (i, j)]
        root = {c: c for c in comps}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for x in at[0].tolist():
            for y in at[1].tolist() if i != j else at[0][at[0] > x].tolist():
                a, b = top(comps[x]), top(comps[y])
                # Distances obey the triangle's inequality: two documents can't be nearer than their distances from the pivot differ.
                if a == b or abs(far[x] - far[y]) > 1 - percent / 100 + 1e-9 or not alike(min(len(sets[x]), len(sets[y])), len(sets[x]), len(sets[y]), percent):
                    continue
                if alike(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]), percent):
                    root[max(a, b)] = min(a, b)
                    links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of df: which documents are near copies of one another.

    A document's set holds its distinct runs of `width` words, A-Z lower-cased, split at ASCII white
    space; with fewer words, the whole sequence; a null or empty text has no set and links with
    nothing. Documents are linked if their sets' Jaccard similarity is percent/100 or more. component_id
    is the smallest key reachable over links, itself included, and kept says whether it is the row's own.

    Equal sets form classes, found by a digest of two independent hashes of 64 bits; one member of each
    goes on. Candidates are members that share a band of their min-max signature, and are compared on
    full sets of the second hash, of which the signature knows nothing. The bucket of each band has a pivot, its most widely
    shared member, with which all others are compared on full sets; so a large group of near copies
    costs about as many comparisons as members. What a pivot's group leaves unjoined is compared in
    blocks of bounded size, all with all, but for pairs that are joined already or that their
    distances from the pivot rule out. No bucket is capped.

    Rows that share a key and a text give equal rows. Rows of a null key link with nothing, have a null
    component and are kept. key must be a whole number.
    """
    rows = small_batches(df).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(_signed(width), "id bigint, n bigint, digest binary, bands array<bigint>"))
    classes = written(signed.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "n", "bands")).alias("m")).select("digest", "m.*"))
    member = classes.select("id", "n", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(member.join(sizes, "band"))
    spread = shared.groupBy("id").agg(F.sum("size").alias("spread"))
    pivots = shared.join(spread, "id").groupBy("band").agg(F.max(F.struct("spread", (-F.col("id")).alias("pivot"))).alias("m")).select("band", (-F.col("m.pivot")).alias("pivot"))
    groups = cut(shared.join(pivots, "band").select("pivot", "id", "n").distinct())

    involved = cut(groups.select("id").distinct())
    few = involved.count() <= BROADCAST_IDS
    chosen = rows.join(F.broadcast(involved) if few else involved, "id", "left_semi")
    sets = written(chosen.mapInArrow(_full(width), "id bigint, hashes array<bigint>"))

    # Every member with its group's pivot, whose set is sent to each part of a large group.
    large = cut(groups.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).cast("int").alias("parts")).where("parts > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    parts = F.coalesce("parts", F.lit(1))
    part = groups.where("id <> pivot").join(large, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("parts")
    p = sets.join(groups.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("hashes").alias("p"))
    p = p.join(large, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("parts")
    possible = part.join(sets.select("id", "hashes"), "id").join(p, ["pivot", "part"])
    common = F.size(F.array_intersect("hashes", "p")).cast("long")
    met = cut(possible.select("pivot", "id", common.alias("shared"), F.size("hashes").cast("long").alias("n"), F.size("p").cast("long").alias("n_p")))
    links = met.where(alike(F.col("shared"), F.col("n"), F.col("n_p"), percent)).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    joined = components(links)

    # What lies in one group but in different components.
    in_group = groups.select("pivot", "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    in_group = in_group.join(met.select("pivot", "id", (1 - F.col("shared") / (F.col("n") + F.col("n_p") - F.col("shared"))).alias("far")), ["pivot", "id"], "left").withColumn("far", F.coalesce("far", F.lit(0.0)))
    open_groups = in_group.join(groups.select("pivot", "id", "n"), ["pivot", "id"]).groupBy("pivot").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("c <> d and docs > 2")
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_groups = cut(open_groups.select("pivot", blocks.alias("blocks")))
    few_open = open_groups.count() <= BROADCAST_IDS
    rest = cut(in_group.join(F.broadcast(open_groups) if few_open else open_groups, "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    if rest.limit(1).count():
        paired = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        more = paired.join(sets, "id").select("pivot", "i", "j", "block", "id", "component", "far", "hashes").groupBy("pivot", "i", "j").applyInPandas(_blocked(percent), "a bigint, b bigint")
        joined = components(cut(links.unionByName(more)))

    labelled = classes.select("digest", "id").join(joined, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    linked = signed.where("n > 0 and id is not null").select("id", "n", "digest").join(labelled, "digest").select("id", "n", "component_id")
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of near copies: that of the smallest key. Each row is judged by its own text, so rows that share a key but aren't copies all stay, and so do null keys; columns stay.

    Where a key repeats, rows are told apart by a number in the order of keys, kept with them in the shared folder.
    """
    own = df.columns
    if df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # Null keys keep a null number. Rows of one key are dealt by a hash of the text, so a hot key doesn't meet in one task.
        # Equal texts of one key are one row, those without a word too.
        once = df.where(F.col(key).isNotNull()).withColumn("__code", F.xxhash64(text)).dropDuplicates([key, "__code"]).drop("__code")
        named = number_rows(once, [F.col(key), F.xxhash64(text)], "__row")
        df, key = named.unionByName(df.where(F.col(key).isNull()).withColumn("__row", F.lit(None).cast("long"))), "__row"
    judged = near_duplicates(df, key=key, text=text, width=width, percent=percent).select(F.col(key).alias("id"), "kept")
    gone = cut(judged.where("id is not null and not kept").select(F.col("id").alias(key)))
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").select(*own)


def op5_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 per cent of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+') if x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM split),
member AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS shared FROM member a JOIN member b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON s.doc_id = l.x
"""
