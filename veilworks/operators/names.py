"""Names put right (D32): a span that a model or rule cut badly is widened to its word, and what doesn't belong to the name is taken off its end until nothing changes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilworks.operators.evidence import WORD, trimmed

#: Characters that a name keeps at least; rounds of taking off, more than any word has endings; characters around a span that are looked at.
LEAST, ROUNDS, REACH = 2, 8, 64
#: Fixed value: the syllable that is a copula after an open one or a Latin letter.
SHORT_COPULA = "다"


@dataclass(frozen=True)
class Endings:
    """What follows a name, and what goes before it; the caller's words."""

    particles: list[tuple[str, str]] = field(default_factory=list)
    copulas: list[str] = field(default_factory=list)
    honorifics: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    #: Endings of departments, and what is no name before them.
    departments: list[str] = field(default_factory=list)
    generic: list[str] = field(default_factory=list)
    #: Legal forms before an organization's name, and short ones that stand in brackets.
    forms: list[str] = field(default_factory=list)
    short_forms: list[str] = field(default_factory=list)
    #: Tails that make a word an organization.
    tails: list[str] = field(default_factory=list)


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) or "(?:[^\\s\\S])"


def tail_off(words: list[str]) -> str:
    """A pattern whose group 1 is a word without the longest of these at its end."""
    return f"^([\\s\\S]{{{LEAST},}}?)(?:{_any(words)})\\z"


def last_word_off(whole: list[str], endings: list[str]) -> str:
    """A pattern whose group 1 is a name without its last word, if that is one of `whole` or ends in one of `endings`."""
    return f"^([\\s\\S]{{{LEAST},}}?) +(?:(?:{_any(whole)})|[^ ]*(?:{_any(endings)}))\\z"


def _once(word: Column, person: Column, e: Endings) -> Column:
    """One round; each step works on what the one before left."""
    off = lambda c, pattern: F.regexp_replace(c, pattern, "$1")
    step = lambda c, then: F.element_at(F.transform(F.array(c), then), 1)  # noqa: E731  a step's word is worked out once

    def after_copulas(w: Column) -> Column:
        rest = F.left(w, F.length(w) - 1)
        code = F.ascii(F.right(rest, F.lit(1))) - 0xAC00
        open_ = (code.between(0, 11_171) & (code % 28 == 0)) | rest.rlike(r"[A-Za-z]\z")
        return F.when(w.endswith(SHORT_COPULA) & (F.length(w) > LEAST) & open_, rest).otherwise(w)

    w = step(trimmed(word, e.particles, LEAST, 1), lambda w: off(w, tail_off(e.copulas)))
    w = step(w, after_copulas)
    w = step(w, lambda w: F.when(person, off(w, last_word_off(e.titles, []))).otherwise(off(w, last_word_off(e.titles, e.departments))))
    return step(w, lambda w: F.when(person, off(off(off(w, tail_off(e.honorifics)), tail_off(e.titles)), f"^([\\s\\S]{{{LEAST},}}?)[0-9]+\\z")).otherwise(w))


def repaired(docs: DataFrame, spans: DataFrame, endings: Endings) -> DataFrame:
    """Spans (doc_id, cs, ce, type, detector) of names in docs (doc_id, text), put right, with their value; each once.

    A span without a letter goes; one that begins or ends with other marks loses them, else it grows to
    the ends of its word. Of an organization a legal form before the name goes. Then particles, copulas,
    a title or (of organizations) department that stands apart, and of persons honorifics, titles and
    digits at the end go, as long as LEAST characters stay, until nothing changes (ROUNDS at most). A
    person's name with an organization's tail is one; a department's name alone is none. docs as
    policy.unshared() asks; null ids and texts have no spans.
    """
    own = spans.select("doc_id", "cs", "ce", "type", "detector").join(docs.select("doc_id", "text"), "doc_id")
    part = lambda a, n: F.substring(F.col("text"), a + 1, n)
    own = own.withColumns({
        "said": part(F.col("cs"), F.col("ce") - F.col("cs")), "left": F.regexp_extract(part(F.greatest(F.col("cs") - REACH, F.lit(0)), F.least(F.col("cs"), F.lit(REACH))), rf"([{WORD}]*)\z", 1),
        "right": F.regexp_extract(part(F.col("ce"), F.lit(REACH)), f"^([{WORD}]*)", 1),
    }).where(F.col("said").rlike(f"[{WORD}]"))
    lead, core = F.length(F.regexp_extract("said", f"^([^{WORD}]*)", 1)), F.regexp_extract("said", f"^[^{WORD}]*([\\s\\S]*[{WORD}])[^{WORD}]*$", 1)
    own = own.withColumns({"lead": lead, "core": core})
    own = own.withColumns({
        "from": F.when(F.col("lead") > 0, F.col("cs") + F.col("lead")).otherwise(F.col("cs") - F.length("left")),
        "word": F.concat(F.when(F.col("lead") > 0, "").otherwise(F.col("left")), F.col("core"), F.when(F.col("lead") + F.length("core") < F.length("said"), "").otherwise(F.col("right"))),
    })
    head = f"^(?:(?:{_any(endings.forms)})[^{WORD}]*|(?:{_any(endings.short_forms)})\\))([{WORD}][\\s\\S]+)$"
    person = F.col("type") == "PERSON"
    name = F.when(person, F.col("word")).otherwise(F.regexp_replace("word", head, "$1"))
    own = own.withColumn("name", name).withColumn("from", F.col("from") + F.length("word") - F.length("name"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("name"), lambda w, _: _once(w, person, endings))
    own = own.withColumn("value", folded)
    nameless = ~person & F.col("value").rlike(f"^(?:{_any(endings.generic)})(?:{_any(endings.departments)})$")
    kind = F.when(person & F.col("value").rlike(f"^[\\s\\S]{{{LEAST},}}(?:{_any(endings.tails)})$"), "ORGANIZATION").otherwise(F.col("type"))
    return own.where(~nameless).select("doc_id", F.col("from").alias("cs"), (F.col("from") + F.length("value")).alias("ce"), kind.alias("type"), "detector", "value").distinct()
