"""What follows from spans: decisions, merged entities, rewritten texts, verification of what is left."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.operators.texts import identified, named, own_id

#: Entity types in their order, the action on each, and each one's rank as the label of a merged span.
TYPES = (
    ("PERSON", "tokenize", 7), ("ORGANIZATION", "tokenize", 6), ("KOREAN_PHONE", "tokenize", 2), ("KOREAN_RRN", "block", 19), ("KOREAN_BUSINESS_NO", "tokenize", 3),
    ("EMAIL", "tokenize", 0), ("API_KEY", "block", 22), ("PRIVATE_KEY", "block", 23), ("IP_ADDRESS", "tokenize", 1), ("INTERNAL_TERM", "tokenize", 5),
    ("CARD_NUMBER", "block", 26), ("BANK_ACCOUNT", "block", 27), ("CREDENTIAL", "block", 28), ("SENSITIVE_PERSONAL_INFO", "block", 29), ("KOREAN_PASSPORT_NO", "block", 30),
    ("KOREAN_DRIVER_LICENSE_NO", "block", 31), ("KOREAN_ALIEN_REGISTRATION_NO", "block", 32), ("INSTITUTION_ID", "tokenize", 4), ("CONFIDENTIAL_MATTER", "block", 34), ("CONFIDENTIAL_MARKER", "confirm", 8),
)
ACTIONS = ("pass", "confirm", "tokenize", "block")
#: Spans that a document may have.
MOST_SPANS = 512
FILLER = "XXXXXXXXXX"


def types(spark: SparkSession) -> DataFrame:
    """(type, ordinal, action, strength, label_rank)."""
    return spark.createDataFrame([(t, i, a, ACTIONS.index(a), r) for i, (t, a, r) in enumerate(TYPES)], "type string, ordinal int, action string, strength int, label_rank int")


def with_actions(spans: DataFrame) -> DataFrame:
    """An unknown type is blocked. The table of types has twenty rows."""
    known = spans.join(F.broadcast(types(spans.sparkSession)), "type", "left")
    return known.withColumns({"action": F.coalesce("action", F.lit("block")), "strength": F.coalesce("strength", F.lit(3)), "label_rank": F.coalesce("label_rank", F.lit(99))})


def unshared(docs: DataFrame) -> DataFrame:
    """(doc_id) of docs, each once; an error where rows of different texts share an id, or one has none, since spans by id would then fall into the wrong text. texts.identified() tells such rows apart."""
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    wrong = F.raise_error(F.lit("doc_id repeats over different texts, or is null: see texts.identified"))
    return ids.select(F.when((F.col("a") != F.col("b")) | F.col("doc_id").isNull(), wrong).otherwise(F.col("doc_id")).alias("doc_id"))


def check(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_spans, code, blocked_types) of every document (P1): 203 for too many spans, 900 for one that isn't a span, 400 for one to block, else null. Equal rows are judged alike; docs as unshared() asks."""
    of = with_actions(spans).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.bool_or((F.col("cs") < 0) | (F.col("ce") <= F.col("cs"))).alias("bad"),
        F.sort_array(F.collect_set(F.when(F.col("action") == "block", F.col("type")))).alias("blocked"),
    )
    all_ = docs.select("doc_id").join(unshared(docs).join(of, "doc_id", "left"), "doc_id", "left")
    code = F.when(F.col("n_spans") > MOST_SPANS, 203).when(F.col("bad"), 900).when(F.size("blocked") > 0, 400)
    return all_.select("doc_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), code.alias("code"), F.coalesce(F.array_join(F.when(code == 400, F.col("blocked")), ","), F.lit("")).alias("blocked_types"))


def merge(spans: DataFrame) -> DataFrame:
    """(doc_id, cs, ce, action, label, types): overlapping spans made one (P2), with the strictest action and the label of best rank among the types that ask for it. Spans that touch stay apart."""
    before = Window.partitionBy("doc_id").orderBy("cs", "ce", "ordinal", "detector").rowsBetween(Window.unboundedPreceding, -1)
    known = with_actions(spans).withColumn("starts", F.coalesce(F.max("ce").over(before) <= F.col("cs"), F.lit(True)).cast("int"))
    islands = known.withColumn("island", F.sum("starts").over(Window.partitionBy("doc_id").orderBy("cs", "ce", "ordinal", "detector").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("strength", (-F.col("label_rank")).alias("rank"), "type", "action"))
    out = islands.groupBy("doc_id", "island").agg(F.min("cs").alias("cs"), F.max("ce").alias("ce"), best.alias("best"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    return out.select("doc_id", "cs", "ce", F.col("best.action").alias("action"), F.col("best.type").alias("label"), "types")


def targets(merged: DataFrame) -> DataFrame:
    """Merged spans to be replaced."""
    return merged.where("action = 'tokenize'")


#: Draws of a token until one tells nothing of its value.
DRAWS = 64
MARKS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def keyed_digest(secret: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a text under a secret, in hexadecimal digits."""
    if not secret:
        raise ValueError("a secret is needed")
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def token(secret: bytes, scope: Column, label: Column, value: Column) -> Column:
    """The pseudonym of a value within a scope (P4): ten characters of base 32 from a keyed digest.

    Equal values get equal tokens without a shared counter, and nobody without the secret can tell a
    token's value by trying all. A draw that holds four characters of the value in a row (or all of a
    shorter one), in any case, is drawn again, DRAWS times at most; then the token is null.
    """
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 3, F.lit(1))), lambda i: F.upper(F.substring(value, i, F.lit(4))))

    def drawn(k: Column) -> Column:
        digest = keyed_digest(secret, F.concat_ws("\u0000", scope.cast("string"), label, value, k.cast("string")))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.substring(F.lit(MARKS), F.pmod(F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), F.lit(32)) + 1, F.lit(1))), "")

    fine = lambda t: ~F.exists(pieces, lambda p: F.contains(t, p))
    first = drawn(F.lit(0))
    again = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(DRAWS - 1)), drawn), fine), F.lit(0))
    return F.concat(F.lit("⟦"), label, F.lit("_"), F.when(fine(first), first).otherwise(again), F.lit("⟧"))


def rewrite(docs: DataFrame, merged: DataFrame, strategy: str = "redact", secret: bytes = b"") -> DataFrame:
    """(doc_id, text, n_replaced): texts with their targets replaced (P6): redact, mask (by type), pseudonym (by token) or filler (tokens whose drawn letters are all the same, for a second scan, P7). Documents without targets stay as they are; equal rows are rewritten alike. docs as unshared() asks: a text is never rewritten by another's spans."""
    at = targets(merged).join(docs.select("doc_id", "text"), "doc_id") if strategy == "pseudonym" else targets(merged)
    label = F.col("label")
    said = {"redact": F.lit("⟦REDACTED⟧"), "mask": F.concat(F.lit("⟦"), label, F.lit("⟧")), "filler": F.concat(F.lit("⟦"), label, F.lit(f"_{FILLER}⟧")), "pseudonym": None}[strategy]
    if said is None:
        said = token(secret, own_id(docs), label, F.substring(F.col("text"), F.col("cs") + 1, F.col("ce") - F.col("cs")))
    spots = at.select("doc_id", F.struct("cs", "ce", said.alias("said")).alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("spots"))
    spots = unshared(docs).join(spots, "doc_id", "left")
    cursor = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = docs.select("doc_id", "text").join(spots, "doc_id", "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<struct<cs:int,ce:int,said:string>>")))
    folded = F.aggregate("spots", cursor, lambda a, s: F.struct(F.concat(a.out, F.substring(F.col("text"), a.at + 1, s.cs - a.at), s.said).alias("out"), s.ce.alias("at")))
    return done.withColumn("f", folded).select("doc_id", F.concat("f.out", F.substring(F.col("text"), F.col("f.at") + 1, F.length("text"))).alias("text"), F.size("spots").alias("n_replaced"))


def residual(spans: DataFrame, replaced: DataFrame) -> DataFrame:
    """Spans that don't lie within a replacement."""
    r = replaced.select("doc_id", F.col("cs").alias("r_cs"), F.col("ce").alias("r_ce"))
    return spans.join(r, (spans.doc_id == r.doc_id) & (F.col("r_cs") <= F.col("cs")) & (F.col("ce") <= F.col("r_ce")), "left_anti")


def residual_codes(docs: DataFrame, spans: DataFrame, replaced: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, types) of every document after its second scan (P8): 203 for too many spans, 900 for one that doesn't lie in its text, 403 for one outside all replacements that asks for more than a confirmation, with the types of those; then the code of blobs (doc_id, code); else null."""
    size = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    wrong = (F.col("cs") < 0) | (F.col("ce") <= F.col("cs")) | (F.col("ce") > F.col("size"))
    all_ = spans.join(size, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(wrong).alias("wrong"))
    left = with_actions(residual(spans, replaced)).where(F.col("strength") > ACTIONS.index("confirm")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("left"))
    known = size.join(all_, "doc_id", "left").join(left, "doc_id", "left")
    code = F.when(F.col("n") > MOST_SPANS, 203).when(F.col("wrong"), 900).when(F.col("left").isNotNull(), 403)
    if blobs is not None:
        known, code = known.join(blobs.select("doc_id", F.col("code").alias("__blob")), "doc_id", "left"), code.otherwise(F.col("__blob"))
    return known.select("doc_id", code.alias("code"), F.when(code == 403, F.col("left")).otherwise("").alias("types"))


def protected(docs: DataFrame, find, strategy: str = "redact", secret: bytes = b"") -> DataFrame:
    """(doc_id, text, n_replaced) of docs (doc_id, text): found, merged and rewritten in one go (D0, P2, P6), whatever their ids: rows that share one, or have none, are told apart by their texts. find gives the spans of a table of documents."""
    own = identified(docs)
    return named(rewrite(own, merge(find(own)), strategy, secret))


def counts(spans: DataFrame) -> DataFrame:
    """Spans by document and type (P10)."""
    return spans.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def touching(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, cs, ce, type, detector, touches): spans of a rewritten text that lie in none of its tokens (doc_id, cs, ce), and whether they touch one."""
    t = tokens.select(F.col("doc_id").alias("__doc"), F.col("cs").alias("__cs"), F.col("ce").alias("__ce"))
    met = spans.join(t, (F.col("doc_id") == F.col("__doc")) & (F.col("cs") <= F.col("__ce")) & (F.col("__cs") <= F.col("ce")), "left")
    inside = F.coalesce((F.col("__cs") <= F.col("cs")) & (F.col("ce") <= F.col("__ce")), F.lit(False))
    of = met.groupBy("doc_id", "cs", "ce", "type", "detector").agg(F.bool_or(inside).alias("inside"), F.bool_or(F.col("__cs").isNotNull()).alias("touches"))
    return of.where("NOT inside").drop("inside")
