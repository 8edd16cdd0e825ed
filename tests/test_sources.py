"""Files and requests."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilworks.operators import audit, ledger
from veilworks.plans.reports import office_files
from veilworks.sources import corpora, files, requests


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), data)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = packed(word__document_xml=f"<w:document {W}><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tbl><w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p></w:document>")
XLSX = packed(
    xl__workbook_xml='<workbook xmlns:r="r"><sheets><sheet name="A" r:id="r1"/><sheet name="B" state="hidden" r:id="r2"/></sheets></workbook>', xl___rels__workbook_xml="x", xl__sharedStrings_xml="<sst><si><t>shared</t></si></sst>",
    xl__sheet1_xml='<worksheet><row><c t="s"><v>0</v></c><c><v>4.5</v></c></row></worksheet>', xl__sheet2_xml="<worksheet/>",
)


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(XLSX)) as old, zipfile.ZipFile(out, "w") as z:
        for name in old.namelist():
            if "rels" not in name:
                z.writestr(name, old.read(name))
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="sheet1.xml"/><Relationship Id="r2" Target="sheet2.xml"/></Relationships>')
    return out.getvalue()


@pytest.mark.parametrize(
    "path, data, want",
    [
        ("a.txt", "one\r\n\ntwo".encode("utf-16"), [("text", "one"), ("text", "two")]),
        ("a.txt", "가나다".encode("cp949"), [("text", "가나다")]),
        ("a.csv", b'a,"b ""q""\nc",d\ne', [("csv", "a"), ("csv", 'b "q"\nc'), ("csv", "d"), ("csv", "e")]),
        ("b.csv", b'"open', [("damaged", None)]),
        ("a.docx", DOCX, [("docx", "One two"), ("docx", "cell")]),
        ("a.xlsx", xlsx(), [("xlsx", "shared"), ("xlsx", "4.5")]),
        ("a.pptx", packed(ppt__presentation_xml="<p/>", ppt__slides__slide10_xml="<s><p><t>ten</t></p></s>", ppt__slides__slide2_xml="<s><p><t>two</t></p></s>"), [("pptx", "two"), ("pptx", "ten")]),
        ("a.zip", packed(in_xt="plain"), [("text", "plain")]),
        ("a.docx", packed(word__document_xml='<!DOCTYPE x [<!ENTITY a "b">]><x/>'), [("unsafe", None)]),
        ("a.pdf", b"%PDF-1.7", [("unsupported", None)]),
        ("a.bin", b"\x00\x01", [("unknown", None)]),
        ("a.zip", b"PK\x03\x04broken", [("damaged", None)]),
        ("empty.txt", b"", []),
    ],
)
def test_files(spark, path, data, want):
    df = spark.createDataFrame([(path, bytearray(data))], "path string, content binary")
    assert [(r.format, r.text) for r in files.blocks(df).orderBy("region", "at").collect()] == want


@pytest.mark.parametrize(
    "body, code",
    [
        ({"model": "m", "messages": [{"role": "user", "content": "x"}]}, None),
        ('{"model":"m","model":"n","messages":[]}', 300), ("[1]", 200), ("{", 200), ({"tool": 1}, 300), ({"stream": True}, 303), ({"n": 2}, 302), ({"temperature": 2.5}, 302),
        ({"max_tokens": 5, "max_completion_tokens": 6}, 302), ({"max_tokens": 0}, 302), ({"model": "m"}, 201),
        ({"n": "1"}, 302), ({"n": 1.0}, 302), ({"n": None, "messages": [{"role": "user", "content": "x"}]}, None), ({"stop": {"a": 1}}, 302), ({"stop": ["a"], "stream": 1}, 302), ({"model": 3}, 300), ({"messages": None}, 300),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}]}, None), ({"messages": [{"role": "user", "content": [{"type": "image", "text": "x"}]}]}, 301), ({"messages": [{"role": "user", "content": ["x"]}]}, 301),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x", "more": 1}]}]}, 301), ({"messages": [{"role": "judge", "content": "x"}]}, 300), ({"messages": [{"role": "user"}]}, 300), ({"messages": [{"role": "user", "content": "x", "name": "y"}]}, 300),
        ('{"stop":' + "[" * 16 + "]" * 16 + "}", 200), ('{"stop":["\\"[[[[[[[[[[[[[[[[[[["]}', 201),
    ],
)
def test_requests(spark, body, code):
    df = spark.createDataFrame([(1, body if isinstance(body, str) else json.dumps(body))], "request_id long, body string")
    assert requests.scanned(df).first().code == code


START = datetime(2024, 1, 1)


def test_lockout(spark, tmp_path):
    rows = [("a", i, START + timedelta(seconds=i), False) for i in range(6)] + [("a", 9, START + timedelta(seconds=70), True), ("b", 1, START, True), ("a", 10, START + timedelta(seconds=71), False)]
    df = spark.createDataFrame(rows, "client string, id long, ts timestamp, ok boolean")
    got = {(r.client, r.id): r.verdict for r in ledger.lockouts(df).collect()}
    assert [got["a", i] for i in (0, 4, 5, 9, 10)] == ["refused", "refused", "locked", "accepted", "refused"] and got["b", 1] == "accepted"
    from veilworks.streaming import lockout

    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = lockout.lockouts(stream).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        run.processAllAvailable()
        assert {(r.client, r.id): r.verdict for r in spark.table("verdicts").collect()} == got
    finally:
        run.stop()


def test_confirmation_ledger(spark):
    def play(*steps):
        rows = [("t", i, START + timedelta(seconds=s), action, origin, body) for i, (s, action, origin, body) in enumerate(steps)]
        df = spark.createDataFrame(rows, "token string, id long, ts timestamp, action string, origin string, body string")
        return [r.verdict for r in ledger.confirmations(df).orderBy("id").collect()]

    assert play((0, "issue", "o", "b"), (1, "approve", "o", "b"), (2, "redeem", "o", "b"), (3, "redeem", "o", "b")) == ["issued", "approved", "accepted", "refused"]
    assert play((0, "issue", "o", "b"), (1, "approve", "x", "b"), (2, "approve", "o", "b"), (3, "redeem", "o", "b")) == ["issued", "refused", "approved", "accepted"]
    assert play((0, "issue", "o", "b"), (1, "approve", "o", "other"), (2, "approve", "o", "b")) == ["issued", "refused", "refused"]
    assert play((0, "issue", "o", "b"), (400, "approve", "o", "b")) == ["issued", "refused"]


def test_corpora(spark, tmp_path):
    rows = [("a", '{"data":[{"t":"x"},{"t":"y"}]}'), ("a", '{"data":[{"t":'), ("b", '{"data":[]}'), ("b", "{}"), ("b", None)]
    found = corpora.entries(spark.createDataFrame(rows, "path string, content string"), "data array<struct<t: string>>", "data")
    assert sorted((r.path, r.at, r.item and r.item.t) for r in found.collect() if r.item) == [("a", 1, "x"), ("a", 2, "y")]
    assert {(r.group, r.n_items, r.n_damaged) for r in corpora.damaged(found, F.col("path")).collect()} == {("a", 2, 1), ("b", 0, 2)}
    lines = audit.chained(spark.createDataFrame([("2024-01-01", i, "k", str(i)) for i in range(5)], "chain string, seq long, kind string, fields string"))
    corpora.append_lines(lines.where("seq < 3"), str(tmp_path / "a"))
    corpora.append_lines(lines.where("seq >= 3"), str(tmp_path / "a"))
    assert [tuple(r) for r in audit.verified(corpora.read_lines(spark, str(tmp_path / "a"))).collect()] == [("2024-01-01", 5, "ok")]


def test_files_become_pythons_a_few_at_a_time(spark, monkeypatch):
    """However many rows come at once."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.txt" for i in range(1000)]), pa.array([b"a"] * 1000)], ["path", "content"])
    held = [b.num_rows for b in files.slices(iter([batch, batch.slice(0, 0), batch.slice(0, 1)]))]
    assert sum(held) == 1001 and max(held) == files.ROWS
    docs = spark.createDataFrame([(i, f"line {i}\nmore") for i in range(300)], "doc_id long, text string").coalesce(1)
    made = office_files(docs)
    assert {r.text for r in files.blocks(made).collect()} == {f"line {i}" for i in range(300)} | {"more"} and made.count() == 300
