"""Files as blocks of text: (path, format, at, region, place, text), one row a paragraph, line or cell; a row without text for a file that can't be read."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "path string, format string, at int, region int, place string, text string"
#: Containers: entries, bytes of an entry and of all, compression ratio, depth.
MOST_ENTRIES, MOST_ENTRY, MOST_BYTES, MOST_RATIO, MOST_DEPTH = 1000, 64 << 20, 128 << 20, 100, 2

#: Files that become Python's at a time.
ROWS = 64


class Unreadable(ValueError):
    """Why a file gives no text."""


def decoded(data: bytes) -> str:
    """A text file's text (S8): by its byte order mark, else as UTF-8, else as CP949; with a NUL it isn't text."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name)
    if b"\0" in data:
        raise Unreadable("unknown")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("cp949")


def csv_cells(text: str) -> Iterator[tuple[int, str]]:
    """(row, cell) of comma-separated text (S10): doubled quotes, line ends within quotes; an open quote or anything after a closing one is an error."""
    row, at = 1, 0
    while at < len(text):
        if text[at] == '"':
            m = re.compile(r'"((?:[^"]|"")*+)"').match(text, at)
            if not m or text[m.end() : m.end() + 1] not in ("", ",", "\n", "\r"):
                raise Unreadable("damaged")
            cell, at = m[1].replace('""', '"'), m.end()
        else:
            m = re.compile(r"[^,\r\n]*").match(text, at)
            cell, at = m[0], m.end()
        yield row, cell
        if text[at : at + 1] == ",":
            at += 1
            if at == len(text) or text[at] in "\r\n":
                yield row, ""
        if text[at : at + 2] == "\r\n":
            row, at = row + 1, at + 2
        elif text[at : at + 1] in ("\n", "\r"):
            row, at = row + 1, at + 1


def xml_events(data: bytes) -> list[tuple[str, str, dict]]:
    """(start, end or text; local name or text; attributes) of a document; declarations of types or entities are refused."""
    out: list = []
    parser = expat.ParserCreate()

    def refused(*_):
        raise Unreadable("unsafe")

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refused
    parser.StartElementHandler = lambda n, a: out.append(("start", n.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in a.items()}))
    parser.EndElementHandler = lambda n: out.append(("end", n.rpartition(":")[2], {}))
    parser.CharacterDataHandler = lambda t: out.append(("text", t, {}))
    parser.Parse(data, True)
    return out


def paragraphs(data: bytes, block: str, text: str, region: str, skip: tuple[str, ...] = (), hidden: str = "") -> Iterator[tuple[int, str]]:
    """(region, text) of each `block` element: its `text` elements joined, tabs and breaks kept; a `region` element begins a region. Runs with a `hidden` mark and `skip` elements are left out."""
    open_, said, at, off, run_hidden = 0, [], 0, 0, False
    for kind, name, _ in xml_events(data):
        if kind == "start":
            off += name in skip
            at += name == region
            open_ += name == text
            run_hidden = (run_hidden or name == hidden) and name != "r"
            said += ["\t"] if name == "tab" and not off else ["\n"] if name in ("br", "cr") and not off else []
        elif kind == "end":
            off -= name in skip
            open_ -= name == text
            if name == block:
                yield at, "".join(said)
                said = []
        elif open_ and not off and not run_hidden:
            said.append(name)


def sheet_cells(data: bytes, strings: list[str]) -> Iterator[tuple[int, str]]:
    row, kind, value, said, hidden = 0, "", [], False, False
    for what, name, attrs in xml_events(data):
        if what == "start":
            row += name == "row"
            hidden = attrs.get("hidden") in ("1", "true") if name == "row" else hidden
            kind, value = (attrs.get("t", ""), []) if name == "c" else (kind, value)
            said = name in ("v", "t")
        elif what == "end":
            said = said and name not in ("v", "t")
            if name == "c" and value and not hidden:
                yield row, strings[int("".join(value))] if kind == "s" else "".join(value)
        elif said:
            value.append(name)


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def opened(data: bytes) -> zipfile.ZipFile:
    """A container within its limits."""
    z = zipfile.ZipFile(io.BytesIO(data))
    entries = z.infolist()
    if len(entries) > MOST_ENTRIES or any(e.flag_bits & 1 for e in entries):
        raise Unreadable("encrypted" if len(entries) <= MOST_ENTRIES else "too_large")
    if sum(e.file_size for e in entries) > MOST_BYTES or any(e.file_size > MOST_ENTRY or e.file_size > MOST_RATIO * max(1, e.compress_size) for e in entries):
        raise Unreadable("too_large")
    return z


def blocks_of(path: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, int, str, str]]:
    """(format, region, place, text) of a file: by its first bytes, a container's kind by its parts, a text's by its name."""
    suffix = path.rpartition(".")[2].lower()
    if data.startswith(b"%PDF-") or suffix in ("tex", "typ"):
        raise Unreadable("unsupported")
    if data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
        raise Unreadable("legacy")
    if not data.startswith(b"PK\x03\x04"):
        text = decoded(data)
        if suffix == "csv":
            for n, (row, cell) in enumerate(csv_cells(text), 1):
                yield "csv", n, f"row{row}", cell
        else:
            for n, line in enumerate(text.split("\n"), 1):
                yield "text", 1, f"line{n}", line.removesuffix("\r")
        return
    z = opened(data)
    names = set(z.namelist())
    if "word/document.xml" in names:
        for n, (region, said) in enumerate(paragraphs(z.read("word/document.xml"), "p", "t", "tc", ("Fallback", "del"), "vanish"), 1):
            yield "docx", region, f"paragraph{n}", said
    elif "xl/workbook.xml" in names:
        strings = [said for _, said in paragraphs(z.read("xl/sharedStrings.xml"), "si", "t", "si", ("rPh",))] if "xl/sharedStrings.xml" in names else []
        links = {a["Id"]: a["Target"] for k, n, a in xml_events(z.read("xl/_rels/workbook.xml.rels")) if k == "start" and n == "Relationship"}
        n = 0
        for kind, name, a in xml_events(z.read("xl/workbook.xml")):
            if kind == "start" and name == "sheet" and a.get("state", "visible") == "visible":
                for row, cell in sheet_cells(z.read("xl/" + links[a["id"]].removeprefix("/xl/")), strings):
                    n += 1
                    yield "xlsx", n, f"{a['name']}!row{row}", cell
    elif "ppt/presentation.xml" in names:
        for s, name in enumerate(sorted((x for x in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=natural), 1):
            if next((a.get("show") for k, n, a in xml_events(z.read(name)) if k == "start" and n == "sld"), "1") in ("0", "false"):
                continue
            for region, said in paragraphs(z.read(name), "p", "t", "sp"):
                yield "pptx", s * 100_000 + region, f"slide{s}", said
    elif depth >= MOST_DEPTH:
        raise Unreadable("too_deep")
    else:
        for k, name in enumerate(sorted((x for x in names if not x.endswith("/")), key=natural)):
            for kind, region, place, said in blocks_of(name, z.read(name), depth + 1):
                yield kind, k * 1_000_000 + region, f"{name}:{place}", said


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that what becomes Python's is bounded however many rows come at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(files: DataFrame) -> DataFrame:
    """BLOCKS of files (path, content), as spark.read.format("binaryFile") gives them. Blank blocks are dropped; a file that can't be read gives one row, whose format says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, kind, at, region, place, said) for at, (kind, region, place, said) in enumerate(blocks_of(path or "", data or b""), 1) if said.strip()]
                except Unreadable as why:
                    rows = [(path, str(why), 0, 0, "", None)]
                except (ValueError, KeyError, IndexError, expat.ExpatError, zipfile.BadZipFile, NotImplementedError):
                    rows = [(path, "damaged", 0, 0, "", None)]
                if rows:
                    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "format", "at", "region", "place", "text"])

    return files.select("path", "content").mapInArrow(run, BLOCKS)
