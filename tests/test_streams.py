"""Ledgers and audit logs on streams give what they give in batch, over restarts too."""

import random

import pytest
from pyspark.sql import functions as F

from veilworks.operators import audit, ledger
from veilworks.plans.registry import GATE_LIFETIME, gate_events
from veilworks.sources.tables import table
from veilworks.streaming import audit_sink, confirm

DATA = "/root/testdata/sf0.001"


def files(df, folder, parts, by):
    """df in so many files, in the order of `by`; the stream reads one at a time."""
    rows = df.orderBy(by).collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        df.sparkSession.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{k:02}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_gate_ledger_by_hand():
    held = {}
    say = lambda now, *what: ledger.gate_step(held, now, *what, capacity=2, lifetime=10)
    assert say(0, "issue", "a", "x", "o") == "issued" and say(1, "issue", "b", "y", "o") == "issued" and say(2, "issue", "c", "z", "o") == "full"
    assert say(3, "redeem", "a", "x", "p") == "refused" and say(3, "approve", "a", "x", "p") == "refused"
    assert say(3, "approve", "a", "x", "o") == "approved" and say(3, "approve", "a", "x", "o") == "refused"
    assert say(4, "claim", None, "y", "o") == "refused" and say(4, "claim", None, "x", "o") == "accepted" and say(5, "claim", None, "x", "o") == "refused"
    assert say(6, "redeem", "b", "other", "o") == "refused" and say(6, "redeem", "b", "y", "o") == "refused"  # used up by the wrong body
    assert say(7, "issue", "d", "x", "o") == "issued" and say(17, "redeem", "d", "x", "o") == "refused" and not held  # just too late
    assert say(18, None, None, None, None) == "refused"


def test_gates_on_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = gate_events(spark, DATA)
        stream = files(events, str(tmp_path / "in"), 3, "ts")
        for stop in (1, 2):  # the second run goes on where the first ended
            writer = confirm.confirmations(stream, 1, GATE_LIFETIME).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            query = writer.trigger(**({"availableNow": True} if stop == 2 else {"once": True})).start()
            query.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("gate", "id", "verdict").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {tuple(r) for r in ledger.gates(events, 1, GATE_LIFETIME).select("gate", "id", "verdict").collect()}
    assert got == want and {v for _, _, v in got} == {"issued", "full", "approved", "accepted", "refused"}


def lines_of(spark):
    e = table(spark, DATA, "events")
    return e.select(F.col("event_type").alias("chain"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("kind"), F.col("props").alias("fields"))


def test_audit_log_over_restarts(spark, tmp_path):
    folder, lines = str(tmp_path / "log"), lines_of(spark)
    stream = files(lines, str(tmp_path / "in"), 4, "seq")
    for _ in range(2):
        audit_sink.sink(stream, folder).trigger(availableNow=True).start().awaitTermination()
    log = audit_sink.log(spark, folder)
    want = audit.chained(lines.select("chain", "seq", "kind", "fields"))
    assert {tuple(r) for r in log.select("chain", "seq", "prev", "hash").collect()} == {tuple(r) for r in want.select("chain", "seq", "prev", "hash").collect()}
    assert log.count() == lines.count() and {r.verdict for r in audit.verified(log).collect()} == {"ok"}
    segments = sorted(audit.segments(log).collect(), key=lambda r: (r.chain, r.segment))
    for a, b in zip(segments, segments[1:]):
        assert a.chain != b.chain or b.opened_with == a.last_hash
    heads = {r.chain: (r.n_lines, r.last_hash) for r in audit_sink.heads(spark, folder, 3).collect()}
    assert heads == {r.chain: (r.n_lines, r.last_hash) for r in audit.checkpoints(want).collect()}


def test_audit_batches_are_added_once(spark, tmp_path):
    folder, lines = str(tmp_path), lines_of(spark)
    first, second = lines.where("seq < 300"), lines.where("seq >= 300")
    audit_sink.append(first, 0, folder)
    # A batch that was cut short left lines but no heads; a batch that was done comes again.
    audit.chained(second.select("chain", "seq", "kind", "fields")).withColumn("segment", F.lit("none")).write.partitionBy("segment").json(f"{folder}/lines/batch=1")
    assert audit_sink.log(spark, folder).count() == first.count()
    for _ in range(2):
        audit_sink.append(second, 1, folder)
    log = audit_sink.log(spark, folder)
    assert log.count() == lines.count() and {r.verdict for r in audit.verified(log).collect()} == {"ok"}
    with pytest.raises(ValueError, match="before its last"):
        audit_sink.append(first, 2, folder)
    with pytest.raises(ValueError, match="missing"):
        audit_sink.append(second, 9, folder)
    audit_sink.append(lines.where("false"), 2, folder)
    assert audit_sink.heads(spark, folder, 2).count() == audit_sink.heads(spark, folder, 1).count()


def test_a_changed_line_is_told(spark, tmp_path):
    folder, lines = str(tmp_path), lines_of(spark)
    audit_sink.append(lines, 0, folder)
    chain = random.Random(1).choice(sorted({r.chain for r in lines.collect()}))
    log = audit_sink.log(spark, folder)
    at = log.where(F.col("chain") == chain).agg(F.max("seq")).first()[0]
    wrong = log.withColumn("fields", F.when((F.col("chain") == chain) & (F.col("seq") == at), F.lit("other")).otherwise(F.col("fields")))
    assert {r.chain: r.verdict for r in audit.verified(wrong).collect() if r.verdict != "ok"} == {chain: "corrupt"}
