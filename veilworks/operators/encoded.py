"""Encoded blobs: candidates, what they decode to, and the judgement of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.operators.detect import find_all, matches
from veilworks.sources.shared import cut

#: Bytes from which an opaque blob is refused.
OPAQUE_BYTES = 256


#: Escapes that a token of printable ASCII must hold, by kind: what one looks like, and how many.
ESCAPES = {"percent": ("%[0-9A-Fa-f]{2}", 3), "html": ("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 2), "unicode": (r"\\u[0-9A-Fa-f]{4}", 2)}
HINTS = {"percent": "%", "html": "&#", "unicode": "\\\\u"}


def escaped(kind: str) -> str:
    one, least = ESCAPES[kind]
    return f"([!-~]*(?:{one}[!-~]*){{{least},}})"


def kind_of(token: Column) -> Column:
    """The first kind of escapes of which a token holds enough, or null."""
    enough = [F.when(F.regexp_count(token, F.lit(one)) >= least, k) for k, (one, least) in ESCAPES.items()]
    return F.coalesce(*enough)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, cs, ce, kind, value): encoded parts of texts.

    Tokens of printable ASCII with three %XX, else two numeric references, else two \\uXXXX; in other
    tokens, runs of the base-64 alphabets of 16 characters or more. All-hex runs of even length without
    padding are hex; runs with - or _ and without + and / are of the alphabet for addresses.
    """
    found = matches(docs, {k: (escaped(k), HINTS[k]) for k in ESCAPES} | {"run": r"([A-Za-z0-9+/_-]{16,}={0,2})"}, around=512)
    v = F.col("value")
    token = F.concat(F.regexp_extract("before", r"[!-~]*\z", 0), v, F.regexp_extract("next", "^[!-~]*", 0))
    run = F.when(v.rlike("^(?:[0-9a-fA-F]{2})+$"), "hex").when(v.rlike("[-_]") & ~v.rlike("[+/]"), "base64url").otherwise("base64")
    own = found.withColumn("escape", F.when(F.col("name") == "run", kind_of(token)).otherwise(kind_of(v)))
    kept = own.where(F.when(F.col("name") == "run", F.col("escape").isNull()).otherwise(F.col("escape") == F.col("name")))
    return kept.select("doc_id", "cs", "ce", F.when(F.col("name") == "run", run).otherwise(F.col("name")).alias("kind"), "value")


def decoded(kind: Column, value: Column) -> Column:
    """The bytes of a candidate, or null (E2). What isn't an escape stands for itself."""
    body = F.rtrim(F.translate(value, "-_", "+/"), F.lit("="))
    left = F.pmod(F.length(body), F.lit(4))
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(F.lit(4) - left, F.lit(4))))
    # Between escapes, the text's own bytes; each escape, its byte or the bytes of its character.
    gaps = lambda p: F.transform(F.split(value, p, -1), lambda g: F.hex(F.encode(g, "UTF-8")))
    codes = lambda p, group: F.regexp_extract_all(value, F.lit(p), F.lit(group))
    woven = lambda g, c: F.unhex(F.array_join(F.zip_with(g, c, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""))
    percent = woven(gaps(ESCAPES["percent"][0]), codes("%([0-9A-Fa-f]{2})", 1))
    point = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.hex(F.encode(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), "UTF-8")))
    number = lambda r: F.when(F.lower(F.substring(r, 1, 1)) == "x", F.conv(F.substring(r, 2, 6), 16, 10)).otherwise(r).try_cast("bigint")
    html = woven(gaps(ESCAPES["html"][0]), F.transform(codes("&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1), lambda r: point(number(r))))
    # Code units of UTF-16, so that pairs of surrogates come together.
    units = F.regexp_replace(value, r"\\u([0-9A-Fa-f]{4})", "\u0001$1\u0002")
    whole = F.transform(F.regexp_extract_all(units, F.lit("(?:\u0001[0-9A-Fa-f]{4}\u0002)+"), F.lit(0)), lambda r: F.hex(F.encode(F.decode(F.unhex(F.translate(r, "\u0001\u0002", "")), "UTF-16BE"), "UTF-8")))
    unicode = woven(F.transform(F.split(units, "(?:\u0001[0-9A-Fa-f]{4}\u0002)+", -1), lambda g: F.hex(F.encode(g, "UTF-8"))), whole)
    of = F.when(kind == "hex", F.unhex(value)).when(kind == "percent", percent).when(kind == "html", html).when(kind == "unicode", unicode)
    return of.when(left != 1, F.try_to_binary(padded, F.lit("base64")))


def is_text(data: Column) -> Column:
    """Whether bytes are strict UTF-8 without control characters but tab and line ends."""
    whole = F.is_valid_utf8(data.cast("string"))
    return F.coalesce((F.octet_length(data) > 0) & whole & ~F.decode(F.when(whole, data), "UTF-8").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.lit(False))


def opened(blobs: DataFrame) -> DataFrame:
    """blobs with the text that each decodes to, null if it is none, and a number for each."""
    data = decoded(F.col("kind"), F.col("value"))
    numbered = blobs.withColumn("blob", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("cs").cast("string"), F.col("ce").cast("string")))
    return cut(numbered.withColumn("data", data).withColumn("said", F.when(is_text(F.col("data")), F.decode(F.when(is_text(F.col("data")), F.col("data")), "UTF-8"))).drop("data"))


def rescanned(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, size, text, type): every encoded part of each document, whether it decodes to text, and a row for each type that is found in it or in what it holds encoded in turn (E4); two levels, without recursion.

    A part that is itself encoded for half of its length or more isn't text unless what it holds is.
    """
    first = opened(candidates(docs))
    inner = first.where("said is not null").select(F.col("blob").alias("doc_id"), F.col("said").alias("text"))
    second = opened(candidates(inner))
    deeper = second.where("said is not null").select(F.col("doc_id").alias("blob"), F.col("said").alias("text"))
    texts = inner.withColumnRenamed("doc_id", "blob").unionByName(deeper)
    numbered = cut(texts.withColumn("doc_id", F.concat_ws("/", "blob", F.sha2("text", 256))))
    hits = find_all(numbered.select("doc_id", "text")).join(numbered.select("doc_id", "blob"), "doc_id").select("blob", "type").distinct()
    sizes = first.select(F.col("blob").alias("doc_id"), F.length("said").alias("whole"))
    hidden = second.where("said is null").join(sizes, "doc_id").where(2 * F.length("value") >= F.col("whole")).select(F.col("doc_id").alias("blob"), F.lit(True).alias("hidden")).distinct()
    all_ = first.join(hidden, "blob", "left").join(hits, "blob", "left")
    return all_.select("doc_id", "blob", F.octet_length("value").alias("size"), (F.col("said").isNotNull() & F.col("hidden").isNull()).alias("text"), "type")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_blobs, n_text, types, code) of the documents with encoded parts (E5): 401 if one holds a target, else 402 for an opaque one of OPAQUE_BYTES or more."""
    each = rescanned(docs).groupBy("doc_id", "blob").agg(F.first("size").alias("size"), F.first("text").alias("text"), F.collect_set("type").alias("types"))
    opaque = F.bool_or(~F.col("text") & (F.col("size") >= OPAQUE_BYTES))
    types = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",")
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blobs"), F.count_if("text").alias("n_text"), types.alias("types"), F.when(types != "", 401).when(opaque, 402).alias("code"))
