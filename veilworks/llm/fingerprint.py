"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import SPACE_CLASS, let, table

#: Hashes kept of a text.
K = 128
#: Words of a shingle.
WIDTH = 5
#: Hashes are numbers below 2**BITS.
BITS = 48
HEX = BITS // 4


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct hashes of text's shingles, ascending: array<long>.

    Shingles are runs of `width` lower-cased words; with fewer words, the whole sequence is the only
    one; a null text or one without words has none.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), "")

    def hashes(w: Column) -> Column:
        at = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(width)]), 64 - BITS)
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(words, hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together, from the parts' sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both have. Two empty sketches are alike (1.0)."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(float(1 << BITS)) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, from the resemblance and the counts; 1.0 for an empty A."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def encode(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, 6 bytes each, largest byte first."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), HEX, "0")), "")))


def decode(text: Column) -> Column:
    """The sketch that encode() made text from."""
    digits = F.hex(F.unbase64(text))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.call_function("div", F.length(digits), F.lit(HEX)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * HEX + 1, F.lit(HEX)), 16, 10).cast("long"))


def longs(values: list[int]) -> Column:
    """An array literal of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def rank_in(bounds: Column, n: int, value: Column) -> Column:
    """How many of the n ascending bounds are at most value, by bisection."""
    if not n:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.call_function("div", s.lo + s.hi, F.lit(2)).cast("int")
        step = F.when(F.get(bounds, mid) <= value, F.struct((mid + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), mid.alias("hi")))
        return F.when(s.lo < s.hi, step).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve, lambda s: s.lo)


def with_next(df: DataFrame, key: str, tie: list[str], prepare, bucket_rows: int = 512) -> DataFrame:
    """prepare(df), with column `next`: a struct of the row after it in the order of key, then tie; after the last comes the first.

    Rows go to buckets of neighbouring keys, cut at quantiles, by one shuffle; the first row of each
    bucket also goes to the bucket before it, and the first of all to the last. So no task holds more
    than its buckets, and no row waits for another bucket. Null keys come first. Keys that tie share
    a bucket, which should hold rows by the thousand at most.
    """
    n = df.count()
    cuts = min(max(0, n // bucket_rows - 1), 1 << 16)
    bounds = sorted(set(df.select(F.percentile_approx(key, [(i + 1) / (cuts + 1) for i in range(cuts)], 100 * (cuts + 1))).first()[0] or [])) if cuts and n else []
    where = F.when(F.col(key).isNull(), F.lit(0)).otherwise(rank_in(longs(bounds), len(bounds), F.col(key))).cast("int")
    order = F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("key"))
    # One row a bucket; the number of buckets is bounded.
    firsts = {r["b"]: r["first"] for r in df.groupBy(where.alias("b")).agg(F.min(order).alias("first")).collect()}
    full = sorted(firsts)
    before = dict(zip(full, full[-1:] + full[:-1]))
    first_of = F.get(longs([firsts[b]["key"] if b in firsts and firsts[b]["there"] else 0 for b in range(len(bounds) + 1)]), F.col("__b"))
    null_first = bool(full) and not firsts[full[0]]["there"]
    is_first = F.col(key).isNull() | (first_of.eqNullSafe(F.col(key)) & ~(F.lit(null_first) & (F.col("__b") == F.lit(full[0] if full else 0))))
    back = F.get(longs([before.get(b, 0) for b in range(len(bounds) + 1)]), F.col("__b")).cast("int")
    spot = lambda b, halo: F.struct(b.alias("b"), F.lit(halo).alias("halo"))
    spots = F.when(is_first, F.array(spot(F.col("__b"), 0), spot(back, 1))).otherwise(F.array(spot(F.col("__b"), 0)))
    keys = ["__b", "__halo", F.col(key).asc_nulls_first(), *tie]
    dealt = df.withColumn("__b", where).withColumn("__to", F.explode(spots)).withColumns({"__b": F.col("__to.b"), "__halo": F.col("__to.halo")}).drop("__to")
    dealt = prepare(dealt.repartition("__b").sortWithinPartitions(*keys))
    row = F.struct(*[c for c in dealt.columns if not c.startswith("__")])
    after = Window.partitionBy("__b").orderBy(*keys[1:])
    return dealt.withColumn("next", F.lead(row).over(after)).where(F.col("__halo") == 0).drop("__b", "__halo")


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness. Null texts count as empty; rows that tie in doc_id go by their text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, "doc_id", ["text"], lambda df: df.withColumns({"n": F.length("text"), "fp": sketch(F.col("text"))}))
    half = F.call_function("div", F.col("n"), F.lit(2)).cast("int")
    edited = pairs.select(
        "doc_id", "n", "fp", F.col("next.fp").alias("next_fp"),
        F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
    )
    done = edited.select("doc_id", "n", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_fp"))
    return done.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", encode(F.col("fp")).alias("fingerprint"), encode(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_count(F.col("fp")).alias("n_shingles"), containment(F.col("fp"), F.col("edited_fp")).alias("contained_in_edited"),
    )
