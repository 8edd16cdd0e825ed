"""Second looks: at issued tokens, at what must be confirmed, at answers, and at what survives of tokens in them; and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.operators.policy import with_actions

TOKEN_SHAPE = r"^⟦[A-Z][A-Z0-9_]{0,23}_[0-9A-HJKMNP-TV-Z]{10}⟧$"
#: Letters of a token that are drawn; the closing bracket follows them.
DRAWN = 10
#: How many characters of a value may not stand in its token.
LEAK = 4
LIMIT_CODES = ("context_length_exceeded",)


def drawn(token: Column) -> Column:
    """The drawn letters of a token."""
    return F.substring(token, F.length(token) - DRAWN, F.lit(DRAWN))


def leaks(token: Column, value: Column) -> Column:
    """Whether LEAK neighbouring characters of a value, or all of a shorter one, stand in its token's drawn letters, in any case."""
    places = F.sequence(F.lit(1), F.greatest(F.length(value) - (LEAK - 1), F.lit(1)))
    return F.exists(places, lambda i: F.contains(drawn(token), F.upper(F.substring(value, i, F.lit(LEAK)))))


def check_tokens(mapping: DataFrame) -> DataFrame:
    """(doc_id, n, one_to_one, shaped, n_leaks) from mapping (doc_id, label, value, token), each row once (P5): whether tokens and values of a document belong to each other one to one, and have their shape and label."""
    values, named = F.count_distinct("label", "value"), F.col("token").startswith(F.concat(F.lit("⟦"), F.col("label"), F.lit("_")))
    n, tokens = F.count(F.lit(1)), F.count_distinct("token")
    return mapping.groupBy("doc_id").agg(
        n.alias("n"), ((tokens == n) & (values == n)).alias("one_to_one"), F.bool_and(F.col("token").rlike(TOKEN_SHAPE) & named).alias("shaped"),
        F.count_if(leaks(F.col("token"), F.col("value"))).alias("n_leaks"),
    )


def confirm_gate(spans: DataFrame, confirmed: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(doc_id, types, code) of documents with spans that ask for a confirmation, or with categories (doc_id, category) of a sentence classifier (P9): 409 unless confirmed (doc_id) names the document."""
    asked = with_actions(spans).where("action = 'confirm'").select("doc_id", "type")
    if categories is not None:
        asked = asked.unionByName(categories.where("category is not null").select("doc_id", F.col("category").alias("type")))
    asked = asked.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
    given = confirmed.select("doc_id").distinct().withColumn("given", F.lit(True))
    return asked.join(given, "doc_id", "left").select("doc_id", "types", F.when(F.col("given").isNull(), 409).alias("code"))


def check_answers(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, code) of every answer (R2): 200 for a text that isn't valid UTF-8, 501 for one with a span to block, else null. A null text passes."""
    blocked = with_actions(spans).where("action = 'block'").select("doc_id").distinct().withColumn("blocked", F.lit(True))
    code = F.when(~F.is_valid_utf8("text"), 200).when(F.col("blocked"), 501)
    return answers.select("doc_id", "text").join(blocked, "doc_id", "left").select("doc_id", code.alias("code"))


def context_limit(status: Column, body: Column, codes: tuple[str, ...] = LIMIT_CODES) -> Column:
    """Whether a provider's error says that a request was too long (R8): status 400 or 413 and one of the codes. False for what isn't JSON."""
    return F.coalesce(status.isin(400, 413) & F.get_json_object(body, "$.error.code").isin(*codes), F.lit(False))


def survival(token: Column, text: Column) -> Column:
    """What is left of a token in a text (R9): exact, case, bracket, spacing, label (only the drawn letters stand) or missing; the first that holds."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    said = F.when(F.contains(text, token), "exact").when(F.contains(F.lower(text), F.lower(token)), "case").when(F.contains(text, inner), "bracket")
    said = said.when(F.contains(F.regexp_replace(text, r"[ \t\n]", ""), token), "spacing").when(F.contains(text, drawn(token)), "label")
    return said.otherwise("missing")


def error_body(code: Column, types: Column) -> Column:
    """The body of a refusal: its code and the types that were blocked, never where they stand (K3). Null without a code."""
    return F.when(code.isNotNull(), F.to_json(F.struct(F.struct(code.alias("code"), types.alias("types")).alias("error"))))


def _whole(content: Column, at: Column) -> Column:
    """The place `at` in UTF-8 bytes, or where the character that it would split begins."""
    inside = lambda k: F.coalesce(F.hex(F.substring(content, at - k + 1, F.lit(1))).between("80", "BF"), F.lit(False))
    return F.when(~inside(0), at).when(~inside(1), at - 1).when(~inside(2), at - 2).otherwise(at - 3)


def details(spans: DataFrame, docs: DataFrame, reach: int = 30) -> DataFrame:
    """(doc_id, cs, type, value, context) of each span (K6): the value with `reach` bytes around it, cut between characters, tabs, line ends and backslashes escaped for a tab-separated file."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    upto = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c)))
    found = spans.join(docs.select("doc_id", "text"), "doc_id").withColumns({"content": F.encode("text", "UTF-8"), "begin": upto("cs"), "end": upto("ce")})
    found = found.withColumns({"begin": _whole(F.col("content"), F.greatest(F.col("begin") - reach, F.lit(0))), "end": _whole(F.col("content"), F.least(F.col("end") + reach, F.length("content")))})
    near = F.decode(F.substring("content", F.col("begin") + 1, F.col("end") - F.col("begin")), "UTF-8")
    return found.select("doc_id", "cs", "type", escaped(F.col("value")).alias("value"), escaped(near).alias("context"))


def byte_offsets(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with `begin` and `end` in UTF-8 bytes beside their code points."""
    upto = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c)))
    return spans.join(docs.select("doc_id", "text"), "doc_id").withColumns({"begin": upto("cs"), "end": upto("ce")}).select(*spans.columns, "begin", "end")
