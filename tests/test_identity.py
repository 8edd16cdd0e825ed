"""Rows of repeated and null ids: each text keeps its own spans, and none is rewritten by another's."""

import pytest
from pyspark.sql import functions as F

from veilworks.operators import detect, policy, texts

A = "x mail ann@mail.example.org today, or bob@mail.example.org please"
B = "write to joe@mail.example.org or to jo.b@mail.example.org soon"
ROWS = [(1, "nothing"), (2, A), (2, A), (3, A), (3, B), (None, A), (None, B), (None, None), (4, None), (5, "")]


def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def hidden(text):
    for word in ("ann@mail.example.org", "bob@mail.example.org", "joe@mail.example.org", "jo.b@mail.example.org"):
        text = text.replace(word, "⟦REDACTED⟧")
    return text


def test_matches_are_of_their_own_row(spark):
    found = detect.matches(rows(spark), {"mail": r"([a-z.]+@[a-z.]+)"}, carry=("text",)).collect()
    assert len(found) == 2 * 6 and all(r.text[r.cs : r.ce] == r.value for r in found)


def test_protected_texts_of_shared_ids(spark):
    out = sorted(((r.doc_id, r.text, r.n_replaced) for r in policy.protected(rows(spark), detect.find_all).collect()), key=str)
    assert out == sorted(((i, t and hidden(t), 2 if t and "@" in t else 0) for i, t in ROWS), key=str)


def test_shared_ids_are_refused_where_not_told_apart(spark):
    same = spark.createDataFrame([(2, A), (2, A)], "doc_id long, text string")
    assert {r.text for r in policy.rewrite(same, policy.merge(detect.find_all(same))).collect()} == {hidden(A)}
    for wrong in ([(3, A), (3, B)], [(None, A)]):
        docs = spark.createDataFrame(wrong, "doc_id long, text string")
        for act in (lambda d: policy.rewrite(d, policy.merge(detect.find_all(d))), lambda d: policy.check(d, detect.find_all(d))):
            with pytest.raises(Exception, match="doc_id repeats"):
                act(docs).collect()


def test_checks_of_shared_ids(spark):
    docs = texts.identified(spark.createDataFrame([(3, "card 4111 1111 1111 1111"), (3, "plain"), (None, "card 4111 1111 1111 1111")], "doc_id long, text string"))
    out = {(r.doc_id, r.code) for r in texts.named(policy.check(docs, detect.find_all(docs))).collect()}
    assert out == {(3, 400), (3, None), (None, 400)}


def test_empty_table(spark):
    docs = rows(spark).where(F.lit(False))
    assert policy.protected(docs, detect.find_all).count() == 0 and policy.check(docs, detect.find_all(docs)).count() == 0


def test_numbers_at_the_start_of_a_line(spark):
    """A line end after a letter or digit isn't part of what touches a number."""
    docs = spark.createDataFrame([(1, "phone\n010-2345-6789"), (2, "no 7\n900101-1234567"), (3, "x900101-1234567"), (4, "pay $\n12345678")], "doc_id long, text string")
    assert {(r.doc_id, r.value) for r in detect.find_all(docs).collect()} == {(1, "01023456789"), (2, "9001011234567")}
    assert detect.countable(docs).where("doc_id = 4 and digits = '12345678'").count() == 1
