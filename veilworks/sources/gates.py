"""What a request must pass before it is read: who sends it, and the order of refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEARER = r"^[Bb][Ee][Aa][Rr][Ee][Rr] ([\x21-\x7E]{1,256})$"


def authenticated(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """requests (header, ...) with `origin` (T11): that of origins (origin, token_sha256) whose digest is the token's; null for a strange token or a malformed header. Of origins that share a digest the first is taken."""
    token = F.nullif(F.regexp_extract("header", BEARER, 1), F.lit(""))
    known = origins.groupBy("token_sha256").agg(F.min("origin").alias("origin"))
    return requests.withColumn("token_sha256", F.sha2(token, 256)).join(known, "token_sha256", "left").drop("token_sha256")


#: Characters of a confirmation's mark.
MARK = 32


def gate(authorised: Column, path: Column, method: Column, content_type: Column, paths: list[str], *, headers: Column | None = None, locked: Column | None = None, approval: str = "", local: Column | None = None, marks: Column | None = None, grade: Column | None = None) -> Column:
    """The status that a request is refused with, or null (T10): the first that applies.

    400 for several Authorization headers, 429 for a locked sender, 401 for a strange one, 404, 405 and 415 for
    the path, the method and the type; on the approval path 403 for one that isn't local, and 400 for any
    confirmation mark; elsewhere 400 for several marks, an empty or a long one; then the code of its grade.
    marks: the values of the confirmation header. What isn't given isn't asked; null is no.
    """
    yes = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    own = F.coalesce(marks, F.array().cast("array<string>")) if marks is not None else F.array().cast("array<string>")
    approving = F.coalesce(path == approval, F.lit(False)) if approval else F.lit(False)
    asked = F.when(F.coalesce(headers, F.lit(1)) > 1, 400) if headers is not None else F.when(F.lit(False), 400)
    asked = asked.when(yes(locked), 429).when(~yes(authorised), 401).when(~(yes(path.isin(*paths)) | approving), 404).when(~yes(method == "POST"), 405).when(~yes(content_type == "application/json"), 415)
    if local is not None:
        asked = asked.when(approving & ~yes(local), 403)
    misshapen = (F.size(own) > 1) | F.exists(own, lambda m: (F.length(m) == 0) | (F.length(m) > MARK))
    asked = asked.when((approving & (F.size(own) > 0)) | misshapen, 400)
    return asked.otherwise(grade) if grade is not None else asked
