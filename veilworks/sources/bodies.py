"""Bodies of requests and answers: rebuilt for the provider, scanned, returned, and noticed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA_URI = r"^data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/]*={0,2})$"
#: Bytes that one inline file may have.
MOST_BYTES = 32 << 20
#: What an answer may not hold.
REFUSED = ("tool_calls", "function_call", "audio", "images", "logprobs")
NOTICE = "This request was not sent."


def provider_bodies(segments: DataFrame, model: str) -> DataFrame:
    """(conv_id, body): the request for the provider (K1), built again from the segments (conv_id, seg, role, text) only: one fixed model, one answer, no stream."""
    messages = F.transform(F.sort_array(F.collect_list(F.struct("seg", "role", "text"))), lambda s: F.struct(s.role.alias("role"), s.text.alias("content")))
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.col("messages"), F.lit(1).alias("n"), F.lit(False).alias("stream")))
    return segments.groupBy("conv_id").agg(messages.alias("messages")).select("conv_id", body.alias("body"))


def client_body(id_: Column, text: Column, reason: Column) -> Column:
    """The answer for the client (K2)."""
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), reason.alias("finish_reason"))
    return F.to_json(F.struct(id_.alias("id"), F.lit("chat.completion").alias("object"), F.array(choice).alias("choices")))


def scanned_answers(answers: DataFrame) -> DataFrame:
    """(answer_id, code, role, text, reason) of provider answers (answer_id, body) (S6): the first choice. 600 for what isn't JSON or holds no choice, 601 for a choice with what isn't text; a reason that isn't a plain word is `stop`."""
    shape = "choices array<struct<message:struct<role:string,content:string," + ",".join(f"{k}:string" for k in REFUSED) + ">,finish_reason:string,logprobs:string>>"
    c = F.get(F.from_json("body", shape).choices, F.lit(0))
    other = F.coalesce(*(c.message.getField(k) for k in REFUSED), c.logprobs).isNotNull()
    code = F.when(F.call_function("try_parse_json", F.col("body")).isNull() | c.isNull(), 600).when(other, 601)
    reason = F.when(c.finish_reason.rlike("^[a-z_]{1,32}$"), c.finish_reason).otherwise("stop")
    shown = lambda x: F.when(code.isNull(), x)
    return answers.select("answer_id", code.alias("code"), shown(c.message.role).alias("role"), shown(c.message.content).alias("text"), shown(reason).alias("reason"))


def inline_files(parts: DataFrame) -> DataFrame:
    """(part_id, mime, extension, content, code) of inline files (part_id, name, uri) (S2): 302 for what isn't canonical base 64 with its padding, or too large. Of the name only a plain extension is used."""
    mime, body = (F.regexp_extract("uri", DATA_URI, k) for k in (1, 2))
    data = F.try_to_binary(body, F.lit("base64"))
    fine = F.coalesce(F.col("uri").rlike(DATA_URI) & (F.translate(F.base64(data), "\r\n", "") == body) & (F.octet_length(data) <= MOST_BYTES), F.lit(False))
    extension = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"^[^/\\]*\.([A-Za-z0-9]{1,16})$", 1))
    return parts.select("part_id", F.when(fine, mime).alias("mime"), extension.alias("extension"), F.when(fine, data).alias("content"), F.when(~fine, 302).alias("code"))


def notices(refusals: DataFrame) -> DataFrame:
    """(id, body) of refusals (id, code) as ordinary answers (K8): a notice, and the decision; nothing for a request that passes."""
    decision = F.when(F.col("code") == 409, "confirm").when(F.col("code").between(400, 499), "blocked").otherwise("refused")
    message = F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(NOTICE + " ("), F.col("code").cast("string"), F.lit(")")).alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    return refusals.where("code is not null").select("id", F.to_json(F.struct(F.lit("chat.completion").alias("object"), F.array(choice).alias("choices"), decision.alias("decision"))).alias("body"))
