"""Detectors: from texts to spans (doc_id, cs, ce, type, detector, value), in code points."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.functions import numbers
from veilworks.functions.structures import IBAN_STRUCTURES
from veilworks.operators import view
from veilworks.sources.shared import cut

SPAN = ["doc_id", "cs", "ce", "type", "detector", "value"]


@dataclass(frozen=True)
class Pattern:
    """What a detector looks for: `body`, after `lead` (which isn't part of the span) and not where the next two characters match `stop`. Only texts that match the cheap `hint` are searched."""

    type: str
    name: str
    body: str
    lead: str = ""
    stop: str = ""
    hint: str = ""
    valid: Callable[[Column], Column] | None = None


#: Words that announce a secret; the same spaced out, with one or two blanks, dots, stars, dashes or low lines after the first letter.
SECRETS = ("password", "passwd", "token", "secret", "otp", "pin")
SPACED = "|".join(f"[{w[0].upper()}{w[0]}][ .*_-]{{1,2}}" + "[ .*_-]{0,2}".join(f"[{c.upper()}{c}]" for c in w[1:]) for w in SECRETS)
#: Where a pattern is to end with its text it says \\z: for Java, $ also stands before a last line end.
#: Our own specification of identifiers, keys and credentials; lookaround-free, so that any linear-time engine reads them alike.
PATTERNS = (
    Pattern(
        "EMAIL", "email", r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-][A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        r"(?:^|[^A-Za-z0-9!#$%&'*+/=?^_`{|}~-])", r"[A-Za-z0-9_]|-[A-Za-z0-9]", "@", numbers.mailbox,
    ),
    Pattern("IP_ADDRESS", "ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"(?:^|[^A-Za-z0-9.])", r"[A-Za-z0-9]|\.[0-9]", r"#[0-9]\.[0-9]", numbers.octets),
    Pattern("IP_ADDRESS", "ipv6", r"[0-9A-Fa-f:.]{1,44}[0-9A-Fa-f:]", r"(?:^|[^A-Za-z0-9:.])", r"[A-Za-z0-9:]|\.[0-9]", r":[0-9A-Fa-f]*:", numbers.ipv6),
    Pattern("API_KEY", "prefix", r"(?:sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})", r"(?:^|[^A-Za-z0-9])", r"[A-Za-z0-9]", "sk-|AKIA"),
    Pattern("API_KEY", "bearer", r"[A-Za-z0-9._~+/=-]{20,}", r"[Bb]earer +", hint="earer "),
    Pattern("API_KEY", "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"(?:^|[^A-Za-z0-9])", hint="eyJ"),
    Pattern("PRIVATE_KEY", "pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", hint="-----BEGIN "),
    Pattern("CREDENTIAL", "marker", r"[^ \t\r\n\"';,]{4,}", r"(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Oo]tp|[Pp]in|비밀번호|암호) *[=:] *\"?", hint="[=:]"),
    Pattern("CREDENTIAL", "spaced", r"[^ \t\r\n\"';,]{4,}", rf"(?:{SPACED}) *[=:] *\"?", hint="[=:]"),
    Pattern("CREDENTIAL", "userinfo", r"[^ \t\r\n/@:]+:[^ \t\r\n/@]+@", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://", hint="://"),
    Pattern("CREDENTIAL", "basic", r"[A-Za-z0-9+/]{8,}={0,2}", r"[Bb]asic +", hint="asic "),
    Pattern("KOREAN_PASSPORT_NO", "passport", r"[MSRODmsrod](?:[0-9]{8}|[0-9]{3}[A-Za-z][0-9]{4})", r"(?:^|[^A-Za-z0-9])", r"[A-Za-z0-9]", "#[0-9]{3}"),
)
#: Dashes that may join groups of digits: the hyphen, those of General Punctuation, the minus and the small and wide hyphens.
DASHES = "-\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uFE58\uFE63\uFF0D"
_JOINT = f"[{DASHES}. \\t]"
_GROUPS = f"[0-9]+(?:{_JOINT}{{1,3}}[0-9]+)*"
#: Groups of digits joined by up to three separators, and once by a line end beside a dash (V4).
RUN = f"{_GROUPS}(?:(?:{_JOINT}?[{DASHES}]\\n{_JOINT}?|{_JOINT}?\\n[{DASHES}]{_JOINT}?){_GROUPS})?"
#: Digits that letters follow are consumed first, so that no run begins within them.
RUNS = f"[0-9]+[A-Za-z][0-9A-Za-z]*|({RUN})"
#: As RUNS, but once by a line end without a dash.
WRAPPED_RUNS = f"[0-9]+[A-Za-z][0-9A-Za-z]*|({_GROUPS}(?:{_JOINT}{{0,3}}\\n{_JOINT}{{0,3}}{_GROUPS})?)"
#: Words that explain a number broken by a line end, within CUE_REACH characters before it.
CUES = {
    "KOREAN_RRN": ("주민", "생년월일", "등록번호", "외국인"),
    "KOREAN_ALIEN_REGISTRATION_NO": ("주민", "생년월일", "등록번호", "외국인"),
    "KOREAN_PHONE": ("전화", "연락", "휴대", "핸드폰", "팩스", "tel", "phone", "mobile", "fax"),
    "CARD_NUMBER": ("카드", "card"),
    "KOREAN_BUSINESS_NO": ("사업자",),
    "KOREAN_DRIVER_LICENSE_NO": ("면허",),
}
CUE_REACH = 30
#: What stands before twelve digits that are a licence's, how far, and the regions of older licences.
LICENCE_WORD, LICENCE_REACH = "면허", 20
REGIONS = ("서울", "부산", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주", "대구", "인천", "대전", "울산", "광주")
#: What makes the number beside it an amount, one blank between them or none; and dates.
CURRENCY_AFTER = ("원", "만원", "억원", "천원", "달러", "엔", "위안", "유로", "krw", "usd", "jpy", "cny", "eur", "円", "元")
CURRENCY_BEFORE = ("$", "₩", "¥", "€", "krw", "usd", "eur")
AMOUNT_AFTER = "(?i)^ ?(?:" + "|".join(CURRENCY_AFTER) + ")"
AMOUNT_BEFORE = "(?i)(?:" + "|".join(map(re.escape, CURRENCY_BEFORE)) + r") ?\z"
_MONTH_DAY = "(?:(?:0[13578]|1[02]){0}(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11){0}(?:0[1-9]|[12][0-9]|30)|02{0}(?:0[1-9]|[12][0-9]))"
_DATE = "(?:" + "|".join("(?:19|20)[0-9][0-9]{0}".format(c) + _MONTH_DAY.format(c) for c in ("-", "[.]")) + ")"
DATES = rf"^{_DATE}(?:[^0-9]+{_DATE})*\z"
#: What marks up a text: commands, braces, brackets, calls, comments to the end of their line; an escaped character stays.
MARKED, MARKS = r"[\\${}#\[]", r"\\[A-Za-z]+|\\[,!;:-]|\\([^A-Za-z,!;:-])|\\\z|[{}$\[\]]|#[A-Za-z][A-Za-z.]*|#\[|%[^\n]*\n?[ \t]*"
IFSC = r"(?:^|[^A-Za-z0-9])([A-Za-z]{4}0[A-Za-z0-9]{6})"
IBAN = r"(?:^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,32})"
MOST_DIGITS = 34
#: Characters between an anchor and its account.
NEAR = 40
#: Number rules, tried on every window of a digit run: by its digits and, where the grouping matters, its shape (group sizes joined by their separators).
RULES: tuple[tuple[str, str, Callable[[Column, Column], Column]], ...] = (
    ("KOREAN_PHONE", "Pattern", lambda d, s: numbers.phone(d)),
    ("KOREAN_RRN", "Pattern", lambda d, s: numbers.resident_number(d, "1-4")),
    ("KOREAN_ALIEN_REGISTRATION_NO", "Pattern", lambda d, s: numbers.resident_number(d, "5-8")),
    ("KOREAN_BUSINESS_NO", "Checksum", lambda d, s: numbers.business_number(d)),
    ("CARD_NUMBER", "Checksum", lambda d, s: numbers.card(d)),
    ("BANK_ACCOUNT", "Checksum", lambda d, s: numbers.clabe(d)),
    ("BANK_ACCOUNT", "Pattern", lambda d, s: d.rlike("^62[0-9]{14,17}$") | s.isin("3-7", "5-8")),
    ("KOREAN_DRIVER_LICENSE_NO", "Pattern", lambda d, s: (s == "2-2-6-2") & F.substring(d, 1, 2).between("11", "28")),
)
#: What marks a foreign account beside it, and how many digits the account has (shape or rule, least, most).
ANCHORS = (("2-2-2", 8, 8), ("5-3", 7, 12), ("3-3", 6, 10), ("routing", 4, 17))
IFSC_DIGITS = (9, 18)


def _ends(gaps: pa.Array, wholes: pa.Array) -> pa.Array:
    """Where each match of a text ends: running sums of the lengths of gaps and matches within each row."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(wholes), 0), np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.cumsum(np.asarray(gaps.flatten(), np.int64) + np.asarray(wholes.flatten(), np.int64))
    first = np.concatenate([[0], sums])[at[:-1]]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sums - np.repeat(first, sizes), pa.int32()))


def alike(pattern: str) -> bool:
    """Whether Java's engine and the linear one read a pattern alike: without ends before a last line end, word boundaries, classes of one's own within others, possessive quantifiers and looks around."""
    fine = r"\\(?:[tnrfzA]|x[0-9A-Fa-f]{2}|[^A-Za-z0-9])"
    for inner in re.findall(r"\\.|\[(\^?\]?(?:\\.|[^\]\\])*)\]", pattern, re.S):
        left = re.sub(fine, "", inner)
        if "[" in left or "&&" in left or "\\" in left or left.lstrip("^").startswith("]"):
            return False
    rest = re.sub(r"(\\.)|\[\^?(?:\\.|[^\]\\])*\]", lambda m: m[1] or "C", pattern, flags=re.S)
    rest = re.sub(fine, "", rest)
    if re.search(r"[$\\\[\]]|[*+?}]\+|\(\?(?!:|[is]+\)|-i:)", rest):
        return False
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:  # counts past its limit
        return False
    return True


def exact(pattern: str) -> bool:
    """Whether the linear-time engine finds the very matches of Java's: read alike, no bare dot (Java's stops at more line ends), and no letters but ASCII ones that are sought in either case."""
    bare = re.sub(r"\\.|\[\^?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    cased = "(?i" in pattern and (re.search(r"\\x[89A-Fa-f]|[^\x00-\x7f]-|-[^\x00-\x7f]", pattern) or any(c.lower() != c or c.upper() != c for c in pattern if not c.isascii()))
    return alike(pattern) and "." not in bare and not cased


#: Bytes of texts whose matches are placed at a time; bytes that stand in no UTF-8 text, before a match, before its group 1 once more, and after that.
PIECE = 1 << 18
_MARKS = b"\xff\\0\xfe\\1\xfd"
_HIT = pa.struct([("k", pa.int32()), ("cs", pa.int32()), ("ce", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("next", pa.string())])
READ = "struct<may:array<int>,hits:array<struct<k:int,cs:int,ce:int,value:string,before:string,next:string>>>"


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last one ends, and the bytes of them all."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _cuts(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The texts that lie between places of data."""
    sizes = last - first
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = data[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(own))


def _placed(texts: pa.Array, pattern: str, around: int) -> tuple[np.ndarray, list]:
    """Of each match in texts (valid, none of them null) the row; and cs, ce, value, before, next."""
    marked_at, marked = _bytes(pc.replace_substring_regex(texts, pattern, _MARKS))
    at, data = _bytes(texts)
    whole, value, end = (np.flatnonzero(marked == m) for m in (0xFF, 0xFE, 0xFD))
    row = np.searchsorted(marked_at, whole, "right") - 1
    size = end - value - 1
    first = whole - np.concatenate([[0], np.cumsum(size + 3)])[:-1]  # less what was put in before
    last = first + value - whole - 1
    same = row[1:] == row[:-1]
    low, high = at[row], at[row + 1]
    low[1:][same], high[:-1][same] = first[:-1][same], last[1:][same]
    row, size, first, last, low, high = (x[size > 0] for x in (row, size, first, last, low, high))
    chars = None if not len(data) or data.max() < 0x80 else np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
    number = (lambda x: x) if chars is None else (lambda x: np.searchsorted(chars, x))
    place = (lambda x: x) if chars is None else (lambda x: chars[x])
    begin, stop = number(at[row]), number(last)
    before = _cuts(data, place(np.maximum(number(first) - around, number(low))), first)
    next_ = _cuts(data, last, place(np.minimum(stop + around, number(high))))
    return row, [pa.array((number(last - size) - begin).astype(np.int32)), pa.array((stop - begin).astype(np.int32)), _cuts(data, last - size, last), before, next_]


def _pieces(texts: pa.Array, at: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of texts, of PIECE bytes together or of one text."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts.take(pa.array(at))), np.int64)) // PIECE
    yield from np.split(at, np.flatnonzero(np.diff(sizes)) + 1) if len(at) else []


def _lists(rows: list[np.ndarray], values: pa.Array, n: int) -> pa.Array:
    """Values as lists by row, those of a row as they come."""
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(np.argsort(row, kind="stable"))))


def _read(patterns: tuple[tuple[str, str], ...], around: int) -> Callable[[pa.Array], pa.Array]:
    """For each text the matches of those patterns (pattern, hint) that a linear-time engine reads as Java's does, found over whole columns; and the numbers of the others that may match it: all that match, and few that don't."""
    own = [exact(p) for p, _ in patterns]
    asked = []
    for (p, hint), whole in zip(patterns, own):
        looks = [x for x in (hint.removeprefix("#"), p) if x and alike(x)]
        digits = ["[0-9]"] if hint.startswith("#") and (whole or not alike(p)) else []
        asked.append((looks[:-1] + digits or looks) if whole else looks + digits)  # where a hint is there, its texts are searched at once
    caseless = ["(?i" in p or "(?i" in hint for p, hint in patterns]

    def run(texts: pa.Array) -> pa.Array:
        try:
            texts.validate(full=True)
            known = True
        except pa.ArrowInvalid:  # bytes that are no UTF-8, which Java replaces
            known = False
        there = np.asarray(texts.is_valid())
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(texts, "[\u212a\u017f]"), False)) if known and any(caseless) else np.zeros(len(texts), bool)  # letters whose small ones are k and s: ASCII to one engine only
        rows, numbers, hit_rows, hits = [], [], [], []
        for k, (looks, either) in enumerate(zip(asked, caseless)):
            like = there
            for x in looks if known else ():
                at = np.flatnonzero(like)  # only what is left is looked at again
                if not len(at):
                    break
                some = texts if len(at) == len(texts) else texts.take(pa.array(at))
                like = np.zeros(len(texts), bool)
                like[at] = np.asarray(pc.match_substring_regex(some, x))
            java = odd if either else np.zeros(len(texts), bool)
            if known and own[k]:
                for at in _pieces(texts, np.flatnonzero(like & ~java)):
                    row, parts = _placed(texts.take(pa.array(at)), patterns[k][0], around)
                    hit_rows.append(at[row])
                    hits.append(pa.StructArray.from_arrays([pa.array(np.full(len(row), k, np.int32)), *parts], fields=list(_HIT)))
            else:
                java = like | java
            at = np.flatnonzero(java)
            rows.append(at)
            numbers.append(np.full(len(at), k, np.int32))
        may = _lists(rows, pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), len(texts))
        return pa.StructArray.from_arrays([may, _lists(hit_rows, pa.concat_arrays(hits) if hits else pa.array([], _HIT), len(texts))], ["may", "hits"])

    return run


def matches(docs: DataFrame, patterns: dict[str, str | tuple[str, str]], id_: str = "doc_id", text: str = "text", around: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, name, cs, ce, value, before, next): where group 1 of each named pattern lies, which must end the match, and up to `around` characters on both sides of the match, no further than the neighbouring match.

    A pattern may come with a hint, a cheaper pattern that every text with a match matches too; # before
    it says that such a text holds a digit. A linear-time engine reads the texts by columns. Of patterns
    that it reads as Java's does (exact()), its matches are taken; of others it tells which texts are
    looked at, and Java's says what matches, as in the few texts that both may read otherwise. One scan
    for all patterns, and places are told within the row, so nothing is shuffled and rows of one id, or
    of none, don't touch one another: each gives the places of its own text. Equal rows give equal
    matches, as often as they come. Null texts give nothing. Columns of docs named like `text` and
    `id_` are all that is read, and those of `carry`, which go with each match.
    """
    both = {n: (p, "") if isinstance(p, str) else p for n, p in patterns.items()}
    of = lambda p: F.struct(F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("value"))
    looks = {n: F.array_contains("__read.may", k) & F.col(text).rlike(p) for k, (n, (p, _)) in enumerate(both.items())}
    no_hits = F.lit(None).cast("array<struct<k:int,cs:int,ce:int,value:string,before:string,next:string>>")
    found = [F.when(looks[n], F.struct(F.lit(n).alias("name"), of(p).alias("m"), no_hits.alias("hits"))) for n, (p, _) in both.items()]  # one look is enough where nothing is found
    none = F.lit(None).cast("struct<gaps:array<string>,whole:array<string>,value:array<string>>")
    told = F.when(F.size("__read.hits") > 0, F.struct(F.lit("").alias("name"), none.alias("m"), F.col("__read.hits").alias("hits")))
    each_ = F.when(F.size("__read.may") > 0, F.array(told, *found)).otherwise(F.array(told))
    read = F.arrow_udf(_read(tuple(both.values()), around), READ)
    each = docs.select(id_, text, *carry, read(F.col(text)).alias("__read")).select(*carry, F.col(id_).alias("doc_id"), F.explode(F.filter(each_, lambda x: x.isNotNull())).alias("s"))
    n = F.size("s.m.whole")
    lengths = lambda c: F.transform(c, F.length)
    each = each.withColumn("ends", F.arrow_udf(_ends, "array<int>")(lengths(F.slice("s.m.gaps", 1, n)), lengths(F.col("s.m.whole"))))
    prev = F.concat(F.array(F.lit("")), F.slice("s.m.whole", 1, n - 1)).alias("prev")
    follow = F.concat(F.slice("s.m.whole", 2, n - 1), F.array(F.lit(""))).alias("follow")
    zipped = F.arrays_zip(F.col("ends").alias("ce"), "s.m.value", F.slice("s.m.gaps", 1, n).alias("gap"), F.slice("s.m.gaps", 2, n).alias("rest"), prev, follow)
    before, next_ = (lambda z: F.right(F.concat(z.prev, z.gap), F.lit(around))), (lambda z: F.left(F.concat(z.rest, z.follow), F.lit(around)))
    hit = lambda z: F.struct(F.lit(0).alias("k"), (z.ce - F.length(z.value)).alias("cs"), z.ce.alias("ce"), z.value.alias("value"), before(z).alias("before"), next_(z).alias("next"))
    rows = each.select(*carry, "doc_id", "s.name", F.explode(F.coalesce("s.hits", F.transform(zipped, hit))).alias("z")).where("z.value <> ''")
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.get(F.array(*map(F.lit, both)), F.col("z.k")))
    return rows.select(*carry, "doc_id", name.alias("name"), "z.cs", "z.ce", "z.value", "z.before", "z.next")


def wanted(patterns: tuple[Pattern, ...]) -> dict[str, str | tuple[str, str]]:
    """What matches() looks for: the patterns, runs of digits, bank codes and international account numbers."""
    named: dict[str, str | tuple[str, str]] = {f"{p.type}/{p.name}": (f"{p.lead}({p.body})", p.hint) for p in patterns}
    return named | {"refused": (f"^({view.REFUSED})$", view.REFUSED), "run": (RUNS, "#"), "ifsc": (IFSC, "#[A-Za-z]0[A-Za-z0-9]"), "iban": (IBAN, "#[A-Z][0-9]{2}")}


def searched(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, carry: tuple[str, ...] = ()) -> DataFrame:
    """matches() of the patterns and of runs of digits, bank codes and international account numbers, in one scan."""
    return matches(docs, wanted(patterns), carry=carry)


def find_patterns(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, found: DataFrame | None = None) -> DataFrame:
    """Spans of the patterns (D6, D8-D10, D17-D20, and forms of D21 and D22)."""
    named = {f"{p.type}/{p.name}": p for p in patterns}
    found = (matches(docs, {n: (f"{p.lead}({p.body})", p.hint) for n, p in named.items()}) if found is None else found).where(F.col("name").isin(*named))
    for n, p in named.items():
        wrong = F.col("next").rlike(f"^(?:{p.stop})") if p.stop else F.lit(False)
        found = found.where((F.col("name") != n) | (~wrong & (p.valid(F.col("value")) if p.valid else F.lit(True))))
    return found.select("doc_id", "cs", "ce", F.split("name", "/")[0].alias("type"), F.split("name", "/")[1].alias("detector"), "value")


def digit_windows(docs: DataFrame | None, found: DataFrame | None = None, beside: bool = False) -> DataFrame:
    """(doc_id, cs, ce, digits, shape), with beside also (run, run_at, before, next): every range of neighbouring groups of each digit run, up to MOST_DIGITS digits (V4, V5).

    A group that a letter touches is no part of a run. shape: the sizes of the groups, joined by - for
    one dash and by ~ for any other separator. beside: the run's own text, where it begins, and what is
    around it, as far as found tells.
    """
    runs = (matches(docs, {"run": (RUNS, "#")}) if found is None else found).where("name = 'run'")
    runs = runs.withColumns({"groups": F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)), "gaps": F.split("value", "[0-9]+", -1)})
    runs = runs.withColumns({"least": F.col("before").rlike(r"[A-Za-z0-9]\z").cast("int"), "most": F.size("groups") - F.col("next").rlike("^[A-Za-z0-9]").cast("int")})
    total = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    first = runs.where("least < most").withColumn("a", F.explode(F.sequence(F.col("least"), F.col("most") - 1)))
    pair = first.withColumn("b", F.explode(F.sequence(F.col("a"), F.least(F.col("most"), F.col("a") + MOST_DIGITS) - 1)))
    own = F.slice("groups", F.col("a") + 1, F.col("b") - F.col("a") + 1)
    pair = pair.withColumn("digits", F.array_join(own, "")).where(F.length("digits") <= MOST_DIGITS)
    joint = F.when(F.get("gaps", F.col("a") + 1).rlike(rf"^[{DASHES}]\z"), "-").otherwise("~")
    shape = F.aggregate(F.sequence(F.col("a"), F.col("b")), F.lit(""), lambda s, k: F.concat(s, F.when(k == F.col("a"), "").when(F.get("gaps", k).rlike(rf"^[{DASHES}]\z"), "-").otherwise("~"), F.length(F.get("groups", k)).cast("string")))
    cs = F.col("cs") + total("gaps", F.col("a") + 1) + total("groups", F.col("a"))
    ce = F.col("cs") + total("gaps", F.col("b") + 1) + total("groups", F.col("b") + 1)
    more = [F.col("value").alias("run"), F.col("cs").alias("run_at"), "before", "next"] if beside else []
    return pair.select("doc_id", cs.alias("cs"), ce.alias("ce"), "digits", shape.alias("shape"), *more)


def find_numbers(docs: DataFrame | None, windows: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of the number rules (D1-D5, D15, and the pairs of D16) on every window, with its columns `keep`."""
    windows = digit_windows(docs) if windows is None else windows
    hits = F.filter(F.array(*[F.when(rule(F.col("digits"), F.col("shape")), F.struct(F.lit(t).alias("type"), F.lit(d).alias("detector"))) for t, d, rule in RULES]), lambda x: x.isNotNull())
    return windows.select("doc_id", "cs", "ce", F.explode(hits).alias("hit"), F.col("digits").alias("value"), *keep).select("doc_id", "cs", "ce", "hit.type", "hit.detector", "value", *keep)


def find_anchored(docs: DataFrame | None, found: DataFrame | None = None) -> DataFrame:
    """Spans of accounts beside what marks them (D14, D16, D16c): sort codes and the like by their shape, routing numbers by their checksum, bank codes of letters and digits.

    An anchor goes with the first number of the right length that begins and ends within NEAR
    characters of it and doesn't touch it; both are spans.
    """
    found = matches(docs, {"run": (RUNS, "#"), "ifsc": (IFSC, "#[A-Za-z]0[A-Za-z0-9]")}) if found is None else found
    windows = digit_windows(None, found)
    kind = F.when(numbers.routing_number(F.col("digits")) & (F.col("shape") == "9"), "routing").otherwise(F.col("shape"))
    limits = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, lo, hi in ANCHORS for x in (name, (lo, hi)[k])]), F.col("kind"))
    anchors = windows.withColumn("kind", kind).where(F.col("kind").isin(*(a for a, _, _ in ANCHORS)))
    anchors = anchors.select("doc_id", "cs", "ce", F.col("digits").alias("value"), limits(0).alias("lo"), limits(1).alias("hi"), F.when(F.col("kind") == "routing", "Checksum").otherwise("Pattern").alias("detector"))
    codes = found.where("name = 'ifsc'").where(~F.col("next").rlike("^[A-Za-z0-9]"))
    anchors = anchors.unionByName(codes.select("doc_id", "cs", "ce", "value", F.lit(IFSC_DIGITS[0]).alias("lo"), F.lit(IFSC_DIGITS[1]).alias("hi"), F.lit("Pattern").alias("detector")))
    w = windows.select(F.col("doc_id").alias("w_doc"), F.col("cs").alias("w_cs"), F.col("ce").alias("w_ce"), "digits")
    apart = ((F.col("w_ce") <= F.col("cs")) | (F.col("w_cs") >= F.col("ce"))) & (F.col("w_cs") >= F.col("cs") - NEAR) & (F.col("w_ce") <= F.col("ce") + NEAR)
    beside = anchors.join(w, (F.col("doc_id") == F.col("w_doc")) & apart & F.length("digits").between(F.col("lo"), F.col("hi")))
    own = beside.groupBy("doc_id", "cs", "ce", "value", "detector", "lo").agg(F.min(F.struct("w_cs", "w_ce", "digits")).alias("account"))
    span = lambda cs, ce, detector, value: F.struct(cs.alias("cs"), ce.alias("ce"), detector.alias("detector"), value.alias("value"))
    two = F.array(span(F.col("cs"), F.col("ce"), F.col("detector"), F.col("value")), span(F.col("account.w_cs"), F.col("account.w_ce"), F.lit("Pattern"), F.col("account.digits")))
    out = own.select("doc_id", F.explode(two).alias("s")).select("doc_id", "s.cs", "s.ce", F.lit("BANK_ACCOUNT").alias("type"), "s.detector", "s.value")
    return out.distinct()


def find_ibans(docs: DataFrame | None, found: DataFrame | None = None) -> DataFrame:
    """Spans of international account numbers (D16b): a country's code, two digits, and as many characters as its structure asks for, with single blanks or none."""
    found = (matches(docs, {"iban": (IBAN, "#[A-Z][0-9]{2}")}) if found is None else found).where("name = 'iban'")
    known = F.broadcast(found.sparkSession.createDataFrame([(c, iban_pattern(c, b)) for c, _, b in IBAN_STRUCTURES], "country string, pattern string"))  # 89 rows
    hit = found.join(known, F.substring("value", 1, 2) == F.col("country")).withColumn("own", F.expr("regexp_extract(value, pattern, 0)")).where("own <> ''")
    after = F.substring(F.concat("value", "next"), F.length("own") + 1, F.lit(1))
    return hit.where(~after.rlike("^[A-Za-z0-9]")).select("doc_id", "cs", (F.col("cs") + F.length("own")).alias("ce"), F.lit("BANK_ACCOUNT").alias("type"), F.lit("Pattern").alias("detector"), F.translate("own", " ", "").alias("value"))


def iban_pattern(country: str, structure: str) -> str:
    """A pattern of a country's numbers from its registry structure: n digits, a capitals, c either, each count fixed."""
    kinds = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Za-z0-9]"}
    return f"^{country}(?: ?[0-9]){{2}}" + "".join(f"(?: ?{kinds[k]}){{{n}}}" for n, k in re.findall(r"(\d+)!([nac])", structure))


def find_accounts(windows: DataFrame, formats: DataFrame) -> DataFrame:
    """Spans of domestic accounts (D11, J5): windows whose number of digits, grouping and subject code fit a row of formats (bank, digits, shape, subject_at, subjects).

    formats is the caller's table; it is joined by the number of digits. A number that is also a phone or business number isn't one.
    """
    other = numbers.phone(F.col("digits")) | numbers.business_number(F.col("digits"))
    f = formats.select("bank", F.col("digits").alias("n_digits"), F.col("shape").alias("f_shape"), "subject_at", "subjects")
    fits = (F.length("digits") == F.col("n_digits")) & (F.col("shape") == F.col("f_shape"))
    subject = F.expr("array_contains(subjects, substring(digits, subject_at, length(subjects[0])))")
    hit = windows.where(~other).join(f, fits).where(subject)
    return hit.groupBy("doc_id", "cs", "ce", "digits").agg(F.array_join(F.sort_array(F.collect_set("bank")), ",").alias("banks")).select("doc_id", "cs", "ce", F.lit("BANK_ACCOUNT").alias("type"), F.lit("Pattern").alias("detector"), F.col("digits").alias("value"), "banks")


def find_terms(docs: DataFrame, terms: list[str], type_: str, detector: str = "Term") -> DataFrame:
    """Spans of dictionary terms, ASCII case ignored, blanks within a term optional.

    Each term is sought on its own, so hits of different terms may overlap. Where a term begins or ends
    with an ASCII letter or digit, the character beside it must be none. An empty term is an error (D0c).
    """
    bodies = {t: "(?i)(" + "[ \\t]*".join(re.escape(c) for c in t if c not in " \t") + ")" for t in terms}
    if not all(t.strip() for t in terms):
        raise ValueError("an empty term")
    found = matches(docs, dict(bodies))
    edge = lambda c: c.rlike("[A-Za-z0-9]")
    inside = (edge(F.substring("value", 1, 1)) & edge(F.right("before", F.lit(1)))) | (edge(F.right("value", F.lit(1))) & edge(F.left("next", F.lit(1))))
    return found.where(~inside).select("doc_id", "cs", "ce", F.lit(type_).alias("type"), F.lit(detector).alias("detector"), "value").distinct()


def label_pattern(labels: list[str]) -> str:
    body = "|".join(re.escape(t) for t in sorted(labels, key=lambda t: (-len(t), t)))
    return f"(?i)(?:^|[^A-Za-z0-9])(?:{body})(?: *[:=#(] *| +)([A-Za-z0-9][A-Za-z0-9/-]{{3,29}})"


def labelled(found: DataFrame) -> DataFrame:
    """find_labelled() from matches of label_pattern()."""
    fine = ~F.col("next").rlike("^[A-Za-z0-9_/-]") & (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3)
    return found.where(fine).select("doc_id", "cs", "ce", F.lit("INSTITUTION_ID").alias("type"), F.lit("Pattern").alias("detector"), "value")


def find_labelled(docs: DataFrame, labels: list[str]) -> DataFrame:
    """Spans of numbers after one of the labels (D25): 4 to 30 letters, digits, slashes and hyphens, three digits at least."""
    return labelled(matches(docs, {"id": label_pattern(labels)}))


def _sides(windows: DataFrame, reach: int) -> tuple[Column, Column]:
    """Up to `reach` characters before and after each window."""
    before = F.right(F.concat("before", F.substring("run", F.lit(1), F.col("cs") - F.col("run_at"))), F.lit(reach))
    after = F.left(F.concat(F.substring("run", F.col("ce") - F.col("run_at") + 1, F.length("run")), "next"), F.lit(reach))
    return before, after


def wrapped(found: DataFrame) -> DataFrame:
    """find_wrapped() from matches of WRAPPED_RUNS, with CUE_REACH characters around."""
    windows = digit_windows(None, found, beside=True)
    windows = windows.where(F.contains(F.substring("run", F.col("cs") - F.col("run_at") + 1, F.col("ce") - F.col("cs")), F.lit("\n")))
    windows = windows.withColumn("ahead", F.lower(_sides(windows, CUE_REACH)[0]))
    explained = reduce(or_, [(F.col("type") == t) & F.col("ahead").rlike("|".join(words)) for t, words in CUES.items()])
    return find_numbers(None, windows, keep=("ahead",)).where(explained).select(*SPAN).distinct()


def find_wrapped(docs: DataFrame) -> DataFrame:
    """Spans of numbers that a line end breaks (D7), after a word that explains them."""
    return wrapped(matches(docs, {"run": (WRAPPED_RUNS, "#\n")}, around=CUE_REACH))


def licences(windows: DataFrame) -> DataFrame:
    """find_licences() from windows with LICENCE_REACH characters or more beside them."""
    before = _sides(windows, LICENCE_REACH)[0]
    new = (F.col("shape") == "12") & F.substring("digits", 1, 2).between("11", "28") & before.contains(LICENCE_WORD)
    named = F.regexp_extract(before, "((?:" + "|".join(REGIONS) + r") ?)\z", 1)
    old = (F.length("digits") == 10) & (F.col("cs") == F.col("run_at")) & (named != "")
    cs = F.when(old, F.col("cs") - F.length(named)).otherwise(F.col("cs"))
    return windows.where(new | old).select("doc_id", cs.alias("cs"), "ce", F.lit("KOREAN_DRIVER_LICENSE_NO").alias("type"), F.lit("Pattern").alias("detector"), F.col("digits").alias("value"))


def find_licences(docs: DataFrame) -> DataFrame:
    """Spans of driver's licences that find_numbers() leaves out (D5): twelve digits in one group after LICENCE_WORD, and the older form of a region's name and ten digits from a run's first group on."""
    return licences(digit_windows(None, matches(docs, {"run": (RUNS, "#")}, around=LICENCE_REACH), beside=True))


def countable_windows(windows: DataFrame) -> DataFrame:
    """countable() from windows with 8 characters or more beside them."""
    before, after = _sides(windows, 8)
    dates = F.substring("run", F.col("cs") - F.col("run_at") + 1, F.col("ce") - F.col("cs")).rlike(DATES)
    return windows.where(~(before.rlike(AMOUNT_BEFORE) | after.rlike(AMOUNT_AFTER) | dates)).select("doc_id", "cs", "ce", "digits", "shape")


def countable(docs: DataFrame) -> DataFrame:
    """digit_windows() without amounts (a currency beside them) and without those that are all dates."""
    return countable_windows(digit_windows(None, matches(docs, {"run": (RUNS, "#")}, around=8), beside=True))


def find_marked(docs: DataFrame) -> DataFrame:
    """Spans of numbers, addresses and hosts that markup breaks (V3): found in the texts without it, in the places of the texts."""
    seen = view.viewed(docs).where(F.col("text").rlike(MARKED))
    plain = seen.select("doc_id", F.regexp_replace("text", MARKS, "$1").alias("text"))
    found = cut(searched(plain, tuple(p for p in PATTERNS if p.type in ("EMAIL", "IP_ADDRESS"))))
    spans = find_patterns(plain, tuple(p for p in PATTERNS if p.type in ("EMAIL", "IP_ADDRESS")), found).unionByName(find_numbers(None, digit_windows(None, found)))
    # Each mark moves what follows it; an escaped character is what follows.
    marks = matches(seen, {"mark": f"({MARKS.replace('([^', '(?:[^')})"}).distinct()  # equal rows once
    kept = F.col("value").rlike(r"(?s)^\\[^A-Za-z,!;:-]$").cast("int")
    so_far = Window.partitionBy("doc_id").orderBy("cs").rowsBetween(Window.unboundedPreceding, 0)
    steps = marks.withColumns({"at": F.sum(F.col("ce") - F.col("cs") - kept).over(so_far).cast("int"), "from": F.col("ce") - kept})
    step = F.struct((F.col("from") - F.col("at")).alias("at"), F.col("from").alias("cs"), (F.col("from") + 1).alias("ce"))
    moved = steps.groupBy("doc_id").agg(F.sort_array(F.collect_list(step)).alias("moved"))
    viewed = seen.where("moved is not null").select("doc_id", "moved")
    return view.back(view.back(spans.select(*SPAN), moved), viewed).distinct()


def unread(found: DataFrame) -> DataFrame:
    """A span that is none, before its text, for each that can't be read with certainty (V2): a document with it is refused (900), whatever else is found."""
    return found.where("name = 'refused'").select("doc_id", F.lit(-1).alias("cs"), F.lit(0).alias("ce"), F.lit("UNREADABLE").alias("type"), F.lit("View").alias("detector"), F.lit("").alias("value"))


def find_all(docs: DataFrame) -> DataFrame:
    """All spans of a document, each once (D0): places in the text, values as the view has them.

    Texts are read through their views, so invisible and wide characters hide nothing. They are scanned
    once; what is found in them is small and kept in the shared folder, and so are the spans, since most
    of what follows reads them more than once.
    """
    found = cut(searched(view.viewed(docs), carry=("moved",)))
    windows = digit_windows(None, found)
    spans = find_patterns(docs, found=found).unionByName(find_numbers(None, windows)).unionByName(find_anchored(None, found)).unionByName(find_ibans(None, found))
    moved = found.where("moved is not null").groupBy("doc_id").agg(F.first("moved").alias("moved"))
    return cut(view.back(spans.select(*SPAN), moved).unionByName(unread(found)).distinct())


def capped(spans: DataFrame, most: int = 513) -> DataFrame:
    """The first spans of each document by place, one more than a document may have."""
    order = Window.partitionBy("doc_id").orderBy("cs", "ce", "type", "detector", "value")
    return spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
