"""Source divergence audit: how far sources of one language are apart in their words, summed over all words by inclusion and exclusion over what each source holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilworks.llm.common import cut, small_batches, table, written

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
TOP_TERMS = 10
#: Terms of a task that are kept before they are handed on.
FLUSH = 300_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
#: In UTF-8 a term is a run of ASCII letters, lower-cased, and of bytes from 0x80 on; all else becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded piece at a time, each as UTF-8."""
    data, at = text.encode("utf-8", "replace").translate(LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term, of each group; summed over FLUSH terms or so before they are handed on."""
    kept: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in kept.items():
            if n:
                keys = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), keys, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        kept.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = kept.setdefault((lang, source), (Counter(), Counter()))
            held: set[bytes] = set()
            for piece in terms(text):
                n.update(piece)
                held.update(piece)
            docs.update(held)
        if sum(len(n) for n, _ in kept.values()) > FLUSH:
            yield from flush()
    yield from flush()


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), exactly; null if no term is kept."""
    exact = lambda c: c.cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (exact(n) + F.lit(2).cast("decimal(1,0)")), exact(total + 2 * kept)) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, part `pair` has the distance to each other source of it, part `term` its `top` words that are commoner than in the language.

    docs (lang, source, text); nulls are read as empty texts, other columns are left alone, and equal
    rows count as often as they come. Groups without words, and languages without kept words, have
    pairs and no terms; an empty table gives no rows.

    The distance of two sources is a sum over all kept words of the language. Words that one source
    holds are priced by its histogram of counts against the other's price of an absent word; a join of
    the sparse postings by word corrects the words that both hold; words that neither holds are a
    constant times their number. So no table of all words by all sources is made.

    Counts are summed in each task and meet by (language, word), so a source, language or word that
    holds most of the rows isn't one task's work. Tables with a row for each group aren't broadcast
    unless Spark finds them small.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(empty("lang"), empty("source"), empty("text"))
    groups = read.select("lang", "source").distinct()
    counted = small_batches(read).mapInArrow(_counted, COUNTED).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_word = Window.partitionBy("lang", "term")
    postings = counted.withColumns({"in_docs": F.sum("docs").over(of_word), "n_lang": F.sum("n").over(of_word), "head": F.col("source") == F.min("source").over(of_word)})
    postings = written(postings.where(F.col("in_docs") >= least_docs).select("lang", "term", "source", "n", "n_lang", "head"))

    langs = postings.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum(F.col("head").cast("long")).alias("kept"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    zero = F.lit(0).cast("long")
    stats = groups.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "total_lang", "kept"])
    stats = cut(stats.withColumn("absent", F.coalesce(price(zero, F.col("total"), F.col("kept")), zero)))

    priced = postings.join(stats, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("kept")))
    words = priced.withColumn("q", price(F.col("n_lang"), F.col("total_lang"), F.col("kept"))).where("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    other = stats.select("lang", F.col("source").alias("item"), F.col("absent").alias("absent_2"), F.col("held").alias("held_2"))
    nearby = stats.join(other, "lang").where(F.col("source") < F.col("item"))
    neither = nearby.select("lang", "source", "item", F.when(F.col("kept") > 0, (F.col("kept") - F.col("held") - F.col("held_2")) * apart(F.col("absent"), F.col("absent_2"))).otherwise(zero).alias("value"))
    counts = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("words"))
    alone = counts.join(other, "lang").where(F.col("source") != F.col("item"))
    alone = alone.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("words") * apart(F.col("p"), F.col("absent_2"))).alias("value"))
    one = priced.select("lang", "term", "source", "p", "absent")
    two = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_2"), F.col("absent").alias("absent_2"))
    p, p_2, a, a_2 = (F.col(c) for c in ("p", "p_2", "absent", "absent_2"))
    both = one.join(two, ["lang", "term"]).where(F.col("source") < F.col("item"))
    both = both.select("lang", "source", "item", (apart(p, p_2) - apart(p, a_2) - apart(a, p_2) + apart(a, a_2)).alias("value"))
    total = [part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for part in (neither, alone, both)]
    sums = total[0].unionByName(total[1]).unionByName(total[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", sides.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT lang, source, d, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS total_lang
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN vocab v ON g.lang = v.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 2)) // (total + 2 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (CAST(n_lang AS HUGEINT) + 2)) // (total_lang + 2 * v) AS BIGINT) AS q
  FROM dense),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) AS f
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
pair_part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(f), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source GROUP BY ALL),
term_part AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair_part UNION ALL SELECT * FROM term_part))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
