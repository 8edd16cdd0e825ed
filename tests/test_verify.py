"""Small cases for token checks, masks, context, samples and gates."""

import pytest
from pyspark.sql import functions as F

from veilworks.operators import context, detect, strata, verify
from veilworks.sources import gates


def test_token_checks(spark):
    rows = [(1, "EMAIL", "a@b.org", "⟦EMAIL_0123456789⟧"), (1, "EMAIL", "c@d.org", "⟦EMAIL_0123456789⟧"), (2, "EMAIL", "x2345y", "⟦EMAIL_0123456789⟧"), (3, "EMAIL", "q", "⟦PHONE_0123456789⟧")]
    got = {r.doc_id: (r.one_to_one, r.shaped, r.n_leaks) for r in verify.check_tokens(spark.createDataFrame(rows, "doc_id long, label string, value string, token string")).collect()}
    assert got == {1: (False, True, 0), 2: (True, True, 1), 3: (True, False, 0)}


def test_survival(spark):
    token = "⟦EMAIL_0123456789⟧"
    texts = [f"x {token}", token.lower(), "[EMAIL_0123456789]", "⟦ EMAIL _ 0123456789 ⟧", "0123456789", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", verify.survival(F.lit(token), F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["exact", "case", "bracket", "spacing", "label", "missing", "missing"]


def test_masks_and_context(spark):
    docs = spark.createDataFrame([(1, "id ab-1234, AB-1234x and AB-5678"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.value for r in context.find_masks(docs, ["AB-####"]).orderBy("cs").collect()] == ["ab-1234", "AB-5678"]
    for bad in ("###", "####", "A" * 37 + "####"):
        with pytest.raises(ValueError):
            context.mask_pattern(bad)
    d = spark.createDataFrame([(1, "account 1234567" + " x" * 300 + " 7654321"), (2, "7654321")], "doc_id long, text string")
    got = context.near(detect.digit_windows(d), detect.find_terms(d, ["account"], "CONTEXT")).collect()
    assert [(r.doc_id, r.digits) for r in got] == [(1, "1234567")]


def test_samples_and_gates(spark):
    rows = spark.createDataFrame([("s", i, i % 2 == 0 if i % 5 else None) for i in range(40)], "k string, id long, f boolean")
    got = strata.stratified(rows, "k", F.col("f"), "id", 6, 2, "1").collect()
    assert sum(r.flagged for r in got) == 6 and len(got) == 8
    headers = spark.createDataFrame([(1, "BEARER t"), (2, "Bearer u"), (3, "t"), (4, None)], "id int, header string")
    origins = headers.limit(1).select(F.lit("o").alias("origin"), F.sha2(F.lit("t"), 256).alias("token_sha256"))
    known = gates.authenticated(headers, origins.unionByName(origins))
    assert {r.id: r.origin for r in known.collect()} == {1: "o", 2: None, 3: None, 4: None}
    status = gates.gate(F.col("origin").isNotNull(), F.lit("/a"), F.lit("POST"), F.lit(None).cast("string"), ["/a"])
    assert {r.id: r.s for r in known.select("id", status.alias("s")).collect()} == {1: 415, 2: 401, 3: 401, 4: 401}
