"""Where tokens stand in an answer (R4): what a renderer may turn into a link or fetch is painted from left to right, in linear time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A placeholder as answers hold it.
TOKEN = re.compile(r"⟦[A-Z][A-Z0-9_]{0,23}_[0-9A-HJKMNP-TV-Z]{10}⟧")
#: The kinds of context, the earlier before the later where they lie over one another.
CONTEXTS = ("html_tag", "angle_bracket", "markdown_destination", "markdown_reference", "css_url", "scheme_url", "www_url", "host_path")
#: Schemes that need no slashes.
SCHEMES = ("mailto", "tel", "sms", "data", "javascript", "vbscript", "file", "blob", "urn", "news", "magnet", "geo", "sip", "sips", "xmpp", "cid", "mid", "im")
#: Each takes all that it looks at and never gives back, so a text is read once: a tag runs to its bracket, quoted ones aside, or to the end of the text; other brackets end with their line.
_TAG = r"""<[A-Za-z/!](?:[^"'>]|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+>?"""
_WRITTEN_TAG = r"""&(?:lt|#60|#x3c);[A-Za-z/!](?:(?!&gt;)[^"'>]|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+(?:>|&gt;)?"""
_ANGLE = r"<[^ \t\n\r\f\vA-Za-z/!][^>\n]*+>?"
_BRACKETS = re.compile(f"(?i)(?P<tag>{_TAG}|{_WRITTEN_TAG})|(?P<angle>{_ANGLE})")
_PAREN = re.compile(r"(?s)\\.|[()]")
_REFERENCE = re.compile(r"(?m)^ {0,3}\[[^\]\n]*+\]:([^\n]*)")
_CSS = re.compile(r"(?i)(?<![A-Za-z0-9-])(?:(?:url|image-set)\([^)]*+\)?|@import[^\n]*+)")
_RUN = re.compile(r"[^ \t\n\r\f\v]+")
_LINK_TEXT = re.compile(r"\[((?:(?!\]\()[^\[\n])*+)\]\(")
_SCHEME = re.compile(rf"(?i)(?<![A-Za-z0-9+.-])(?:{'|'.join(SCHEMES)}):")
_WWW = re.compile(r"""(?i)[(\[*_"'<]*+www\.""")
_HOST = re.compile(r"[A-Za-z0-9-]\.[A-Za-z]{2,}+(?:[/?#]|:[0-9])")

Painted = Iterator[tuple[int, int, str]]


def _brackets(text: str) -> Painted:
    for m in _BRACKETS.finditer(text):
        yield m.start(), m.end(), "html_tag" if m.lastgroup == "tag" else "angle_bracket"


def _destinations(text: str) -> Painted:
    """What follows ]( up to its own closing bracket, or the end of the text."""
    at = text.find("](")
    while at >= 0:
        start, depth, end = at + 2, 0, len(text)
        for m in _PAREN.finditer(text, start):
            depth += {"(": 1, ")": -1}.get(m.group(), 0)
            if depth < 0:
                end = m.start()
                break
        yield start, end, "markdown_destination"
        at = text.find("](", end)


def _run_kind(run: str) -> str | None:
    if "://" in run or _SCHEME.search(run):
        return "scheme_url"
    if _WWW.match(run):
        return "www_url"
    return "host_path" if _HOST.search(run) else None


def _runs(text: str) -> Painted:
    """Runs without white space that look like an address; a link's own text is judged apart from what is beside it."""
    edges = sorted({x for m in _LINK_TEXT.finditer(text) for x in m.span(1)})
    k = 0
    for m in _RUN.finditer(text):
        cuts = [m.start()]
        while k < len(edges) and edges[k] < m.end():
            if edges[k] > cuts[-1]:
                cuts.append(edges[k])
            k += 1
        for a, b in zip(cuts, [*cuts[1:], m.end()]):
            if kind := _run_kind(text[a:b]):
                yield a, b, kind


def painted(text: str) -> list[list[tuple[int, int, str]]]:
    """The painted ranges of a text, a list for each painter, in the order in which they count; each list's ranges come in order and apart."""
    references = ((m.start(1), m.end(1), "markdown_reference") for m in _REFERENCE.finditer(text))
    css = ((m.start(), m.end(), "css_url") for m in _CSS.finditer(text))
    return [list(_brackets(text)), list(_destinations(text)), list(references), list(css), list(_runs(text))]


def contexts(text: str) -> list[str | None]:
    """The context of each token of a text: that of its first painted character; None if it has none."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    layers = [[r for r in layer if r[0] < r[1]] for layer in painted(text)]
    starts = [[a for a, _, _ in layer] for layer in layers]
    out = []
    for cs, ce in spans:
        best = None
        for rank, (layer, begin) in enumerate(zip(layers, starts)):
            k = bisect_right(begin, cs) - 1
            k += 1 if k < 0 or layer[k][1] <= cs else 0
            if k < len(layer) and layer[k][0] < ce:
                best = min(best or (len(text), rank, ""), (max(layer[k][0], cs), rank, layer[k][2]))
        out.append(best[2] if best else None)
    return out


def _contexts(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else contexts(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def kinds(text: Column) -> Column:
    """The context of each token in a text, in order, null for none (R4). Only texts with a token leave the JVM; others, null ones too, have none."""
    there = text.contains("⟦") & text.rlike(TOKEN.pattern)
    return F.coalesce(F.arrow_udf(_contexts, "array<string>")(F.when(there, text)), F.array().cast("array<string>"))


def linked(text: Column) -> Column:
    """Whether a token of a text stands in a link's destination or reference, a tag, angle brackets, a style sheet's address or what looks like a web address (R5). A link's own text doesn't count."""
    return F.exists(kinds(text), lambda c: c.isNotNull())


def token_contexts(answers: DataFrame) -> DataFrame:
    """(doc_id, at, context) of each token in order."""
    return answers.select("doc_id", F.posexplode(kinds(F.col("text"))).alias("at", "context"))
