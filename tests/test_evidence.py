import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilworks.operators import evidence, exemplars, ledger, measure, policy, texts
from veilworks.streaming import vault

EVENTS = "scope string, id long, ts timestamp, action string, value string, seconds int"


def at(second: int) -> dt.datetime:
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=second)


def test_scopes_live_expire_and_end(spark):
    did = [("create", 0), ("create", 1), ("issue", 2), ("resolve", 3), ("resolve", 61), ("resolve", 62), ("create", 70), ("resolve", 71), ("drop", 72), ("issue", 73)]
    rows = [("a", i, at(s), action, "v", 60) for i, (action, s) in enumerate(did)] + [("b", 99, at(0), "issue", "v", 60)]
    said = {r.id: r.verdict for r in ledger.scopes(spark.createDataFrame(rows, EVENTS)).collect()}
    assert [said[i] for i in range(10)] == ["created", "exists", "issued", "resolved", "expired", "not_found", "created", "unknown", "dropped", "not_found"]
    assert said[99] == "not_found"


def test_a_full_scope_refuses_new_values_only():
    state, said = {}, []
    for i in range(ledger.MOST_VALUES + 1):
        row = {"ts": at(0), "seconds": 60, "value": str(i)}
        if not i:
            ledger.vault(state, row | {"action": "create"})
        said.append(ledger.vault(state, row | {"action": "issue"}))
    assert said[-2:] == ["issued", "full"] and ledger.vault(state, {"ts": at(0), "seconds": 60, "value": "0", "action": "issue"}) == "issued"


def test_scopes_on_a_stream(spark, tmp_path):
    for n, rows in enumerate(([("a", 1, at(0), "create", "", 60), ("a", 2, at(1), "issue", "v", 60)], [("a", 3, at(2), "resolve", "v", 60), ("b", 4, at(3), "resolve", "v", 60)])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = vault.scopes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "created", 2: "issued", 3: "resolved", 4: "not_found"}


def test_particles_agree_with_the_syllable_before(spark):
    cases = {"은행은": "은행", "은행는": "은행는", "학교는": "학교", "학교은": "학교은", "교는": "교는", "Bank은": "Bank은", "": ""}
    particles = [("은", "final"), ("는", "open")]
    got = {r.w: r.t for r in spark.createDataFrame([(w,) for w in cases], "w string").select("w", evidence.trimmed(F.col("w"), particles).alias("t")).collect()}
    assert got == cases


def test_sensitive_neighbours(spark):
    words = spark.createDataFrame([(1, 0, "x"), (1, 5, "y"), (2, 3, "x"), (2, 3, "x"), (3, 1, "y")], "doc_id long, sentence int, category string")
    persons = spark.createDataFrame([(1, 1), (1, 7), (2, 3)], "doc_id long, sentence int")
    blocked = evidence.sensitive(words, persons)
    assert sorted(map(tuple, blocked.collect())) == [(1, 0, 1), (2, 3, 3)]
    assert sorted(map(tuple, evidence.uncovered(words, blocked).collect())) == [("y", 2)]


def test_a_point_at_an_end_is_behind_it(spark):
    spans = spark.createDataFrame([(1, 4, 6), (1, 5, 6), (2, 0, 1)], "doc_id long, cs int, ce int")
    ends = spark.createDataFrame([(1, 5), (1, 9)], "doc_id long, ce int")
    assert sorted(map(tuple, evidence.numbered(spans, ends, "n").collect())) == [(1, 4, 6, 0), (1, 5, 6, 1), (2, 0, 1, 0)]


def test_bytes_and_forms(spark):
    rows = [(b"",), (b"a",), (b"\xc0\xaf",), (b"\xed\xa0\x80",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary").coalesce(1).select(texts.valid(F.col("b"))).collect()] == [True, True, False, False, None]
    rows = [("é",), ("a​b",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(texts.comparable(F.col("t"))).collect()] == ["é", "ab", None, ""]


def test_exemplars_take_the_top_three_and_the_worst_negative(spark):
    made = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.8, 0.0]), (1, [0.6, 0.0]), (1, [-9.0, 0.0]), (2, [0.7, 0.0])], "label long, v array<double>")
    rows = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "vec_id long, v array<double>")
    none = spark.createDataFrame([], "v array<double>")
    assert (7, 1, 0.8) in map(tuple, exemplars.scored(rows, made, none).collect())
    assert (7, 1, 0.3) in map(tuple, exemplars.scored(rows, made, spark.createDataFrame([([0.5, 0.0],), ([-1.0, 0.0],)], "v array<double>")).collect())


def test_an_exemplar_set_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(exemplars, "MOST", 1)
    many = spark.createDataFrame([(1, [1.0]), (1, [1.0])], "label long, v array<double>")
    with pytest.raises(ValueError):
        exemplars.scored(many, many, many.select("v"))


def test_thresholds_with_ties_and_nulls(spark):
    rows = [("a", 1.0)] * 19 + [("a", 5.0), ("b", 2.0), ("b", None), ("c", None)]
    got = {r.k: r.threshold for r in measure.thresholds(spark.createDataFrame(rows, "k string, s double"), "k", "s", 0.05).collect()}
    assert got == {"a": 5.0, "b": pytest.approx(2.000001)}


def test_touching_tokens(spark):
    spans = spark.createDataFrame([(1, 2, 4, "A", "x"), (1, 5, 8, "B", "x"), (1, 20, 22, "C", "x"), (2, 0, 1, "D", "x")], "doc_id long, cs int, ce int, type string, detector string")
    tokens = spark.createDataFrame([(1, 1, 5)], "doc_id long, cs int, ce int")
    assert {r.type: r.touches for r in policy.touching(spans, tokens).collect()} == {"B": True, "C": False, "D": False}


def test_exemplars_of_any_number_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(exemplars, "BLOCK", 200)
    v = [[float((i * k) % 11 - 5) for k in range(1, 6)] for i in range(90)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(3, v[7]), (90, [1.0, 2.0])], "vec_id long, v array<double>")
    made = spark.createDataFrame([(i % 4, x) for i, x in enumerate(v[:41])], "label int, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = [(90, 0, None)]
    for i, x in [*enumerate(v), (3, v[7])]:
        top = {g: sum(sorted((dot(x, y) for k, y in enumerate(v[:41]) if k % 4 == g), reverse=True)[:3]) / 3 for g in range(4)}
        best = max(top, key=lambda g: (round(top[g], 9), -g))
        want.append((i, best, round(top[best] - max(dot(x, y) for y in v[50:75]), 6)))
    got = exemplars.scored(rows, made, spark.createDataFrame([(x,) for x in v[50:75]], "v array<double>")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    many = spark.range(20_001).selectExpr("cast(id % 2 as int) AS label", "array(cast(id AS double)) AS v")
    assert [tuple(r) for r in exemplars.scored(spark.createDataFrame([(1, [1.0])], rows.schema), many, many.limit(0).select("v")).collect()] == [(1, 0, 19_998.0)]
