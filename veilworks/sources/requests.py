"""Chat requests as JSON: strict scan, parameters, grades."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a request may have.
KEYS = ("model", "messages", "stream", "n", "temperature", "top_p", "max_tokens", "max_completion_tokens", "stop")
SHAPE = "model string, messages array<struct<role string, content string>>, stream boolean, n int, temperature double, top_p double, max_tokens int, max_completion_tokens int"
CAP = 4096


#: Types of parameters, as a variant names them; any other is out of range. Null is as good as absent.
TYPES = {"stream": "^BOOLEAN$", "n": "^BIGINT$", "max_tokens": "^BIGINT$", "max_completion_tokens": "^BIGINT$", "temperature": "^(?:BIGINT|DECIMAL.*|DOUBLE)$", "top_p": "^(?:BIGINT|DECIMAL.*|DOUBLE)$", "stop": "^(?:STRING|ARRAY<(?:STRING|VOID)>)$"}
ROLES = ("system", "user", "assistant")
DEPTH = 16
_MAPS = "array<map<string,variant>>"


def deep(body: Column) -> Column:
    """How deep objects and arrays of a JSON text lie in each other: brackets outside strings are counted."""
    plain = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), '"[^"]*"', "")
    brackets = F.regexp_extract_all(plain, F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda a, b: F.struct((a.now + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a.most, a.now + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a.most)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _strange_part(part: Column) -> Column:
    """Whether a part of a message is other than a text or a file."""
    says, has = F.coalesce(F.try_variant_get(part["type"], "$", "string"), F.lit("")), lambda k: F.map_contains_key(part, k)
    text, file = (says == "text") & (_kind(part["text"]) == "STRING") & ~has("file"), (says == "file") & _kind(part["file"]).startswith("OBJECT") & ~has("text")
    return (F.size(F.array_except(F.map_keys(part), F.array(*map(F.lit, ("type", "text", "file"))))) > 0) | ~(text | file)


def scanned(requests: DataFrame) -> DataFrame:
    """(request_id, code, n_messages, max_tokens) of requests (request_id, body) (S1, S3): the first failure in the order of the checks, or null.

    200 for what isn't one JSON object or lies more than DEPTH deep, 300 for a key that isn't allowed or
    comes twice, and for a model or messages of another shape, 301 for a part of a message that is neither a text
    nor a file, 302 for a parameter of another type, 303 for streaming, 302 for a parameter out of range, 201 for no message.
    """
    strict = F.call_function("try_parse_json", F.col("body"))
    keys, r = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")), F.from_json("body", SHAPE)
    rows = requests.select(
        "request_id", strict.alias("v"), F.json_object_keys("body").isNull().alias("flat"), (F.size(keys) > F.size(F.array_distinct(keys))).alias("twice"),
        (F.size(F.array_except(keys, F.array(*map(F.lit, KEYS)))) > 0).alias("strange"), (deep(F.col("body")) > DEPTH).alias("deep"), r.alias("r"), F.array_contains(keys, "model").alias("named"), F.array_contains(keys, "messages").alias("told"),
    )
    of = lambda key, kind="variant": F.try_variant_get("v", f"$.{key}", kind)
    rows = rows.withColumn("m", of("messages", _MAPS))
    within = lambda c, top: c.isNull() | (~F.isnan(c) & c.between(0, top))
    length = F.coalesce("r.max_completion_tokens", "r.max_tokens")
    fine = (F.coalesce(F.col("r.n"), F.lit(1)) == 1) & within(F.col("r.temperature"), 2) & within(F.col("r.top_p"), 1) & F.coalesce(length > 0, F.lit(True)) & F.coalesce(F.col("r.max_tokens") == F.col("r.max_completion_tokens"), F.lit(True))
    mistyped = reduce(or_, [(_kind(of(k)) != "VOID") & ~_kind(of(k)).rlike(t) for k, t in TYPES.items()])
    parts = lambda m: F.try_variant_get(m["content"], "$", _MAPS)
    listed = lambda m: _kind(m["content"]).startswith("ARRAY")
    misshapen = lambda m: (F.size(F.array_except(F.map_keys(m), F.array(F.lit("role"), F.lit("content")))) > 0) | ~F.coalesce(F.try_variant_get(m["role"], "$", "string").isin(*ROLES), F.lit(False)) | ~(listed(m) | (_kind(m["content"]) == "STRING"))
    shaped = (~F.col("named") | (_kind(of("model")) == "STRING")) & (~F.col("told") | (F.col("m").isNotNull() & ~F.coalesce(F.exists("m", misshapen), F.lit(False))))
    parted = F.coalesce(F.exists("m", lambda m: listed(m) & (parts(m).isNull() | F.coalesce(F.exists(parts(m), _strange_part), F.lit(False)))), F.lit(False))
    code = F.when(F.col("flat") | F.col("deep") | (F.col("v").isNull() & ~F.col("twice")), 200).when(F.col("twice") | F.col("strange") | ~shaped, 300).when(parted, 301).when(mistyped, 302)
    code = code.when(F.col("r.stream"), 303).when(~fine, 302).when(F.coalesce(F.size("r.messages"), F.lit(0)) <= 0, 201)
    return rows.select("request_id", code.alias("code"), F.coalesce(F.size("r.messages"), F.lit(0)).alias("n_messages"), F.least(F.coalesce(length, F.lit(CAP)), F.lit(CAP)).alias("max_tokens"))


def graded(marks: Column, declare: bool) -> Column:
    """The code of a document's grade marks (S5): 102 for several or an unknown one, and for none where one must be declared; 100 for C, 101 for S; null for O."""
    n, first = F.size(marks), F.get(marks, F.lit(0))
    return F.when(n > 1, 102).when(n < 1, F.lit(102 if declare else None).cast("int")).when(first == "C", 100).when(first == "S", 101).when(first != "O", 102)
