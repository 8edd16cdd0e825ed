"""The scan of a document by every detector in order (D0): one pass over the texts for all patterns, then what depends on other spans."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilworks.operators import context, detect, evidence, terms, view
from veilworks.operators.detect import SPAN
from veilworks.operators.policy import TYPES
from veilworks.sources.shared import cut

#: Spans that a document may have, one more than which ends its scan; types that say of whom a sentence speaks.
MOST = 512
IDENTITIES = ("PERSON", "EMAIL", "KOREAN_PHONE", "IP_ADDRESS", "KOREAN_RRN", "KOREAN_ALIEN_REGISTRATION_NO", "KOREAN_PASSPORT_NO", "KOREAN_DRIVER_LICENSE_NO")
#: How the label of a row of counts ends; such a row has three numbers or more of up to three digits, and nothing else.
COUNT_LABELS = (" 수", " 인원")
COUNT_ROW = f"(?:^|\\n)([^0-9\\n]*(?:{'|'.join(COUNT_LABELS)})[ \\t\\r]*[0-9]{{1,3}}(?:[ \\t\\r]+[0-9]{{1,3}}){{2,}}[ \\t\\r]*)"


@dataclass(frozen=True)
class Rules:
    """What an institution adds to the fixed detectors; each part may be left out."""

    #: Words of its own (D23) and marks of confidential papers.
    terms: list[str] = field(default_factory=list)
    markers: list[str] = field(default_factory=list)
    #: Formats of domestic accounts (D11), a table as find_accounts() reads it, and words that make a number near them one.
    formats: DataFrame | None = None
    account_words: list[str] = field(default_factory=list)
    #: Labels and masks of identifiers.
    labels: list[str] = field(default_factory=list)
    masks: list[str] = field(default_factory=list)
    #: Organizations (D24): tails, words that name none, particles; legal forms before a name.
    tails: list[str] = field(default_factory=list)
    generic: list[str] = field(default_factory=list)
    particles: list[tuple[str, str]] = field(default_factory=list)
    short_forms: list[str] = field(default_factory=list)
    forms: list[str] = field(default_factory=list)
    #: Confidential matters (D28): a marker and a subject in a sentence or its neighbour.
    matter_markers: list[str] = field(default_factory=list)
    matter_subjects: list[str] = field(default_factory=list)
    #: Sensitive statements (D29): words by category.
    categories: dict[str, list[str]] = field(default_factory=dict)
    #: Patterns of one's own, as the fixed ones.
    patterns: tuple[detect.Pattern, ...] = ()


def _sentences(ends: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    return evidence.numbered(hits, ends, name)


def _ranges(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, sentence, cs, ce) of the sentences that end at ends; what follows the last end is one too."""
    whole = docs.where(F.length("text") > 0).select("doc_id", F.length("text").alias("ce"))
    all_ = ends.select("doc_id", "ce").unionByName(whole).distinct()
    w = Window.partitionBy("doc_id").orderBy("ce")
    return all_.select("doc_id", (F.row_number().over(w) - 1).alias("sentence"), F.coalesce(F.lag("ce").over(w), F.lit(0)).alias("cs"), "ce")


def _trimmed(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc_id, cs, ce, ...) without the blanks and line ends at their ends."""
    said = F.substring(F.col("text"), F.col("cs") + 1, F.col("ce") - F.col("cs"))
    own = ranges.join(docs.select("doc_id", "text").distinct(), "doc_id").withColumn("__said", said).drop("text")
    lead, trail = (F.length(F.regexp_extract("__said", p, 0)) for p in ("^[ \\t\\n]*", "[ \\t\\n]*\\z"))
    return own.withColumns({"cs": F.col("cs") + lead, "ce": F.col("ce") - trail}).where("cs < ce").drop("__said")


def _personal(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans that tell of a person; numbers to be blocked that stand in a row of counts (matches of COUNT_ROW) don't."""
    r = rows.where((F.col("next") == "") | F.col("next").startswith("\n")).select(F.col("doc_id").alias("__doc"), F.col("cs").alias("__cs"), F.col("ce").alias("__ce"))
    persons = spans.where(F.col("type").isin(*IDENTITIES))
    counted = persons.where(F.col("type").isin(*(t for t, action, _ in TYPES if action == "block"))).join(r, (F.col("doc_id") == F.col("__doc")) & (F.col("__cs") <= F.col("cs")) & (F.col("ce") <= F.col("__ce")), "left_semi")
    return persons.join(counted.select(*SPAN), SPAN, "left_anti")


def _paired(ends: DataFrame, markers: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, sentence) of D28: sentences that hold one of each, or one beside a neighbour with the other, the neighbour too."""
    m, s = (_sentences(ends, x.select("doc_id", "cs", "ce"), "sentence").select("doc_id", "sentence").distinct() for x in (markers, subjects))
    both = m.withColumnRenamed("sentence", "a").join(s.withColumnRenamed("sentence", "b"), "doc_id").where(F.abs(F.col("a") - F.col("b")) <= 1)
    return both.select("doc_id", F.explode(F.array("a", "b")).alias("sentence")).distinct()


def scan(docs: DataFrame, rules: Rules = Rules(), most: int = MOST) -> DataFrame:
    """All spans of every detector over docs (doc_id, text), each once: places in the text, values as the view has them.

    Texts are read through their views, in one pass for all patterns; numbers, accounts, licences,
    organizations and labels are told from what that pass keeps; terms of one's own take a pass of an
    automaton; texts that hold markup, one more without it (V3). What depends on other spans comes after
    them: confidential matters by sentence, and sensitive statements last, for which every span of a
    person is evidence. A document keeps its first `most` + 1 spans (D0b): its refusal for too many needs
    no more, and it is then refused whole.

    Ids as in matches(): rows of one id give the spans of them all, so tell them apart before with
    texts.identified(). Null and empty texts have no spans, an empty table none.
    """
    seen = view.viewed(docs)
    patterns = detect.PATTERNS + rules.patterns
    wanted: dict[str, str | tuple[str, str]] = detect.wanted(patterns) | {"wrapped": (detect.WRAPPED_RUNS, "#\n"), "sentence": evidence.SENTENCE_MARKS}
    if rules.categories:
        wanted["counts"] = (COUNT_ROW, "|".join(COUNT_LABELS))
    if rules.labels:
        wanted["label"] = detect.label_pattern(rules.labels)
    wanted |= {f"mask {m}": context.masked(m) for m in rules.masks}
    if rules.tails:
        wanted["tail"] = evidence.tail_pattern(rules.tails)
    formed = evidence.form_patterns(rules.short_forms, rules.forms)
    wanted |= formed
    found = cut(detect.matches(seen, wanted, around=detect.CUE_REACH, carry=("moved",)))
    of = lambda *names: found.where(F.col("name").isin(*names))
    windows = cut(detect.digit_windows(None, found, beside=True))
    plain = lambda words, type_: terms.find_dictionary(seen, docs.sparkSession.createDataFrame([(w,) for w in words], "term string"), type_)

    parts = [detect.find_patterns(docs, patterns, found), detect.find_numbers(None, windows), detect.find_anchored(None, found), detect.find_ibans(None, found), detect.licences(windows), detect.wrapped(of("wrapped").withColumn("name", F.lit("run")))]
    if rules.formats is not None:
        parts.append(detect.find_accounts(windows, rules.formats))
    if rules.account_words:
        numbers = detect.countable_windows(windows).where(F.length("digits").between(6, detect.MOST_DIGITS))
        parts.append(context.near(numbers, plain(rules.account_words, "CONTEXT")).select("doc_id", "cs", "ce", F.lit("BANK_ACCOUNT").alias("type"), F.lit("Context").alias("detector"), F.col("digits").alias("value")))
    if rules.labels:
        parts.append(detect.labelled(of("label")))
    if rules.masks:
        parts.append(context.unmasked(of(*(f"mask {m}" for m in rules.masks))))
    if rules.tails:
        parts.append(evidence.organizations(of("tail"), rules.tails, rules.generic, rules.particles))
    if formed:
        parts.append(evidence.named(of(*formed), rules.particles))
    if rules.terms:
        parts.append(plain(rules.terms, "INTERNAL_TERM"))
    if rules.markers:
        parts.append(plain(rules.markers, "CONFIDENTIAL_MARKER"))
    first = reduce(DataFrame.unionByName, [p.select(*SPAN) for p in parts]).distinct()

    ends = evidence.ending(of("sentence"))
    late = []
    if rules.matter_markers and rules.matter_subjects:
        at = _paired(ends, plain(rules.matter_markers, "MARKER"), plain(rules.matter_subjects, "SUBJECT"))
        late.append(at.withColumnsRenamed({"sentence": "first"}).select("doc_id", "first", F.col("first").alias("last"), F.lit("CONFIDENTIAL_MATTER").alias("type"), F.lit("Sentence").alias("detector")))
    if rules.categories:
        first = cut(first)
        hits = reduce(DataFrame.unionByName, [plain(words, c) for c, words in rules.categories.items()]).withColumnRenamed("type", "category")
        persons = _personal(first, of("counts"))
        blocked = evidence.sensitive(_sentences(ends, hits, "sentence"), _sentences(ends, persons, "sentence"))
        late.append(blocked.select("doc_id", "first", "last", F.lit("SENSITIVE_PERSONAL_INFO").alias("type"), F.lit("Sentence").alias("detector")))
    spans = first
    if late:
        ranges = _ranges(seen, ends)
        a, b = ranges.select("doc_id", F.col("sentence").alias("first"), "cs"), ranges.select("doc_id", F.col("sentence").alias("last"), "ce")
        whole = _trimmed(seen, reduce(DataFrame.unionByName, late).join(a, ["doc_id", "first"]).join(b, ["doc_id", "last"]))
        spans = spans.unionByName(whole.withColumn("value", F.lit("")).select(*SPAN))
    moved = found.where("moved is not null").groupBy("doc_id").agg(F.first("moved").alias("moved"))
    placed = view.back(spans, moved).unionByName(detect.find_marked(docs).select(*SPAN)).unionByName(detect.unread(found)).distinct()
    return cut(detect.capped(placed, most + 1))
