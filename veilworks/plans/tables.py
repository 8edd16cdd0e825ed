"""Table functions for SQL users (surveyed as built-ins): entities and decisions by text, and the contexts of tokens."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from veilworks.operators import detect, links, policy, texts


@udtf(returnType="at: int, context: string")
class TokenContexts:
    """token_contexts(text): (at, context) of each token of an answer, as links.token_contexts() gives them."""

    def eval(self, text: str) -> Iterator[tuple[int, str | None]]:
        yield from enumerate(links.contexts(text or ""))


def register(spark: SparkSession, docs: DataFrame, prefix: str = "") -> None:
    """Makes three table functions for this session's SQL, to be joined laterally: find_entities(id, text), judge_text(id, text) and token_contexts(text), with `prefix` before the names.

    The first two give what detect.find_all() and policy.check() say of the rows of docs (doc_id, text)
    with this id and text: they are SQL functions over a view of that plan, so Spark decorrelates the
    lateral join into an equi-join and the detectors run once over docs, as everywhere else; a text that
    isn't in docs has no entities. Null ids and texts find their own rows, and repeated ids are told
    apart by their texts. find_entities gives each span once a row that asks. The third runs in Python,
    as its operator does.
    """
    own = texts.identified(docs.select("doc_id", "text"))
    spans = detect.find_all(own)
    kind = dict(docs.dtypes)["doc_id"]
    spans.select("doc_id.id", "doc_id.said", "cs", "ce", "type", "detector", "value").createOrReplaceTempView(f"{prefix}entities")
    policy.check(own, spans).distinct().select("doc_id.id", "doc_id.said", "n_spans", "code", "blocked_types").createOrReplaceTempView(f"{prefix}judgements")
    for name, view, columns in (("find_entities", "entities", "cs INT, ce INT, type STRING, detector STRING, value STRING"), ("judge_text", "judgements", "n_spans BIGINT, code INT, blocked_types STRING")):
        given = ", ".join(c.split(" ")[0] for c in columns.split(", "))
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(asked_id {kind}, asked_text STRING) RETURNS TABLE ({columns}) "
            f"RETURN SELECT {given} FROM {prefix}{view} v WHERE v.said = xxhash64(asked_text) AND v.id <=> asked_id"
        )
    spark.udtf.register(f"{prefix}token_contexts", TokenContexts)
