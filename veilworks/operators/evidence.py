"""What a span means by what stands around it: clauses and sentences, organizations, persons, sensitive statements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilworks.operators.detect import matches

CLAUSE_MARKS = "([.?!。])"
SENTENCE_MARKS = "([.?!。…]|\\n)"
#: Characters of a word that may name an organization.
WORD = "A-Za-z0-9&가-힣"
#: Fixed value: where a tally stops.
MOST_TALLY = 65_535


def clause_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, ce): where clauses end (V8): a mark before white space, but no full stop after an ASCII letter, which may be an abbreviation's."""
    found = matches(docs, {"mark": CLAUSE_MARKS})
    short = (F.col("value") == ".") & F.col("before").rlike(r"[A-Za-z]\z")
    return found.where(F.col("next").rlike("^[ \\t\\n]") & ~short).select("doc_id", "ce")


def ending(found: DataFrame) -> DataFrame:
    """sentence_ends() from matches of SENTENCE_MARKS."""
    return found.where((F.col("value") == "\n") | (F.col("next") == "") | F.col("next").rlike("^[ \\t\\r\\n]")).select("doc_id", "ce")


def sentence_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, ce): where sentences end (V6): after a line end, or a mark before white space or the end of the text."""
    return ending(matches(docs, {"mark": SENTENCE_MARKS}))


def numbered(spans: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """spans with `name`, how many of ends (doc_id, ce) lie before each (J1): a point in intervals by one sorted pass over a document's few rows, not by a join."""
    both = spans.withColumns({"__at": F.col("cs"), "__end": F.lit(0)}).unionByName(ends.select("doc_id", F.col("ce").alias("__at"), F.lit(1).alias("__end")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("__at", F.desc("__end")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("__end").over(order).cast("int")).where("__end = 0").drop("__at", "__end")


def trimmed(word: Column, particles: list[tuple[str, str]], least: int = 2, rounds: int = 2) -> Column:
    """A word without the particles at its end (V13), the longest first, `rounds` times at most, as long as `least` characters are left.

    A particle comes with the kind of syllable that it follows: final (one with a final consonant), open
    (one without), or an empty text for any.
    """

    def once(word: Column) -> Column:
        cut = F.lit(None).cast("string")
        for text, kind in sorted(particles, key=lambda p: (len(p[0]), p[0])):
            rest = F.left(word, F.length(word) - len(text))
            code = F.ascii(F.right(rest, F.lit(1))) - 0xAC00
            syllable = code.between(0, 11_171)
            follows = {"final": syllable & (code % 28 != 0), "open": syllable & (code % 28 == 0), "": F.lit(True)}[kind]
            cut = F.when(word.endswith(text) & (F.length(rest) >= least) & follows, rest).otherwise(cut)
        return F.coalesce(cut, word)

    for _ in range(rounds):
        word = F.element_at(F.transform(F.array(word), once), 1)  # so that a round's word is worked out once, however often it is named
    return word


def _either(tails: list[str]) -> str:
    return "|".join(re.escape(t) for t in sorted(tails, key=lambda t: (-len(t), t)))


def tail_pattern(tails: list[str]) -> tuple[str, str]:
    """What matches() looks for: words with a tail in them."""
    return f"(?:^|[^{WORD}])([{WORD}]*(?:{_either(tails)})[{WORD}]*)", "|".join(tails)


def organizations(found: DataFrame, tails: list[str], generic: list[str], particles: list[tuple[str, str]]) -> DataFrame:
    """find_organizations() from matches of tail_pattern()."""
    own = found.withColumn("own", trimmed(F.col("value"), particles))
    own = own.withColumn("head", F.regexp_extract("own", f"^(.*?)(?:{_either(tails)})$", 1)).where(F.col("head") != "")
    named = F.when(F.col("head").rlike("^[A-Za-z0-9&]+$"), F.col("head").rlike("[A-Z0-9]")).otherwise(F.length("head") >= 2)
    fine = own.where(named & ~F.lower("head").isin(*generic))
    return fine.select("doc_id", "cs", (F.col("cs") + F.length("own")).alias("ce"), F.lit("ORGANIZATION").alias("type"), F.lit("Pattern").alias("detector"), F.col("own").alias("value"))


def find_organizations(docs: DataFrame, tails: list[str], generic: list[str], particles: list[tuple[str, str]]) -> DataFrame:
    """Spans of organizations by their words (D24): one that ends in a tail, particles aside, after a head that names something.

    A head isn't one of `generic`; of ASCII letters it has a capital or a digit; else it has two
    characters or more.
    """
    return organizations(matches(docs, {"word": tail_pattern(tails)}), tails, generic, particles)


def form_patterns(short: list[str], forms: list[str]) -> dict[str, tuple[str, str]]:
    """What matches() looks for: words after a legal form."""
    sides = [re.escape(s) for s in short] + [f"(?:^|[^{WORD}]){re.escape(f)}[^{WORD}]+" for f in forms]
    return {side: (f"{side}([{WORD}]+)", hint) for side, hint in zip(sides, [*short, *forms])}


def named(found: DataFrame, particles: list[tuple[str, str]]) -> DataFrame:
    """find_named_by_form() from matches of form_patterns()."""
    own = found.withColumn("own", trimmed(F.col("value"), particles)).where(F.length("own") >= 2)
    return own.select("doc_id", "cs", (F.col("cs") + F.length("own")).alias("ce"), F.lit("ORGANIZATION").alias("type"), F.lit("Pattern").alias("detector"), F.col("own").alias("value")).distinct()


def find_named_by_form(docs: DataFrame, short: list[str], forms: list[str], particles: list[tuple[str, str]]) -> DataFrame:
    """Spans of organizations by a legal form before them (D24): a word of two characters or more, particles aside, right after one of `short`, or the next word after one of `forms`."""
    return named(matches(docs, form_patterns(short, forms)), particles)


def sensitive(categories: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, first, last): sentences to be blocked (D29): one that names a category and a person, or two neighbours of which one does the one and the other the other.

    categories (doc_id, sentence, category) and evidence (doc_id, sentence) are hits with the number of their sentence.
    """
    a = categories.select("doc_id", "sentence", F.lit(True).alias("a"), F.lit(False).alias("b"))
    b = evidence.select("doc_id", "sentence", F.lit(False).alias("a"), F.lit(True).alias("b"))
    flags = a.unionByName(b).groupBy("doc_id", "sentence").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    w = Window.partitionBy("doc_id").orderBy("sentence")
    beside = F.coalesce(F.lag("sentence").over(w) == F.col("sentence") - 1, F.lit(False))
    flags = flags.withColumns({"a0": beside & F.lag("a").over(w), "b0": beside & F.lag("b").over(w)})
    own = F.when(F.col("a") & F.col("b"), F.struct(F.col("sentence").alias("first"), F.col("sentence").alias("last")))
    two = F.when((F.col("a") & F.col("b0")) | (F.col("b") & F.col("a0")), F.struct((F.col("sentence") - 1).alias("first"), F.col("sentence").alias("last")))
    return flags.select("doc_id", F.explode(F.array_compact(F.array(own, two))).alias("s")).select("doc_id", "s.first", "s.last")


def uncovered(categories: DataFrame, blocked: DataFrame) -> DataFrame:
    """(category, n): sentences that name a category and aren't blocked, MOST_TALLY at most."""
    covered = blocked.select("doc_id", F.explode(F.sequence("first", "last")).alias("sentence")).distinct()
    left = categories.select("doc_id", "sentence", "category").distinct().join(covered, ["doc_id", "sentence"], "left_anti")
    return left.groupBy("category").agg(F.least(F.count(F.lit(1)), F.lit(MOST_TALLY)).alias("n"))


def scored(windows: DataFrame, categories: list[str], thresholds: list[float], ungated: list[str]) -> DataFrame:
    """(doc_id, category, score): what a sentence classifier's scores say of each document (D33), from windows (doc_id, personal, logits), an entry a category, the last of them for none.

    In each window the likeliest category but none must reach its threshold, and its document speak of a
    person unless the category is one of `ungated`. The best of a document's windows counts.
    """
    most = F.array_max("logits")
    each = F.transform("logits", lambda x: F.exp(x - most))
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    named = F.arrays_zip(F.slice(F.transform(each, lambda x: F.round(x / total, 9)), 1, len(categories)).alias("p"), F.array(*map(F.lit, categories)).alias("c"), F.array(*map(F.lit, thresholds)).alias("t"))
    best = F.reduce(named, F.struct(F.lit(-1.0).alias("p"), F.lit("").alias("c"), F.lit(0.0).alias("t")), lambda m, x: F.when(x["p"] > m["p"], F.struct(x["p"].alias("p"), x["c"].alias("c"), x["t"].alias("t"))).otherwise(m))
    tops = windows.select("doc_id", "personal", best.alias("m")).where((F.col("m.p") >= F.col("m.t")) & (F.col("personal") | F.col("m.c").isin(*ungated)))
    return tops.groupBy("doc_id").agg(F.max(F.struct("m.p", "m.c")).alias("m")).select("doc_id", F.col("m.c").alias("category"), F.col("m.p").alias("score"))


def refers_to_person(text: Column, markers: list[str], references: list[tuple[str, str]], left: str, right: str, particles: list[str]) -> Column:
    """Whether a text speaks of a person (D34): a marker anywhere, or a reference (its two words, a blank between) after the start or a mark of `left` and before the end, a mark of `right` or a particle."""
    one = "|".join(re.escape(m) for m in markers)
    two = "|".join(re.escape(f"{a} {b}") for a, b in references)
    after = "|".join([f"[{re.escape(right)}]", *map(re.escape, particles), "$"])
    return text.rlike(f"(?:{one})|(?:^|[{re.escape(left)}])(?:{two})(?:{after})")
