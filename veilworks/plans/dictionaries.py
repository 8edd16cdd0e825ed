"""Queries over large dictionaries and vocabularies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators import terms, wordpiece
from veilworks.plans import oracles, tables
from veilworks.plans.registry import docs_of, query, told_apart
from veilworks.operators.texts import named
from veilworks.sources.tables import table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def phrases(spark, sf_dir) -> DataFrame:
    """(term): every two neighbouring words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.where("size(w) > 1").select(F.explode(pairs).alias("term"))


@query(rf"""WITH RECURSIVE b AS (SELECT regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM benchmark),
t AS (SELECT DISTINCT {_LOWER.format("unnest([w[i] || w[i + 1] for i in range(1, len(w))])")} AS term FROM b),
d AS (SELECT row_number() OVER () AS row, doc_id, text, {_LOWER.format(r"regexp_replace(text, '[ \t]', '', 'g')")} AS own FROM documents WHERE text IS NOT NULL),
h AS (SELECT row, doc_id, text, own, term FROM d JOIN t ON contains(own, term)),
c AS (SELECT row, any_value(regexp_extract_all(text, '(?s).')) AS chars, any_value(list_filter(list_transform(regexp_extract_all(text, '(?s).'), lambda c, i: CASE WHEN c NOT IN (' ', chr(9)) THEN i END), lambda i: i IS NOT NULL)) AS place FROM h GROUP BY row),
p AS (
  SELECT row, doc_id, own, term, strpos(own, term) AS i FROM h
  UNION ALL
  SELECT row, doc_id, own, term, i + strpos(substr(own, i + 1), term) FROM p WHERE strpos(substr(own, i + 1), term) > 0),
s AS (SELECT DISTINCT row, doc_id, i, length(term) AS n FROM p),
o AS (SELECT doc_id, chars, place[i] AS a, place[i + n - 1] AS b FROM s JOIN c USING (row))
SELECT doc_id, CAST(a - 1 AS INTEGER) AS cs, CAST(b AS INTEGER) AS ce, 'INTERNAL_TERM' AS type, 'Term' AS detector, array_to_string(chars[a:b], '') AS value FROM o
WHERE NOT (regexp_matches(chars[a], '[A-Za-z0-9]') AND regexp_matches(coalesce(chars[a - 1], ''), '[A-Za-z0-9]') AND a > 1) AND NOT (regexp_matches(chars[b], '[A-Za-z0-9]') AND regexp_matches(coalesce(chars[b + 1], ''), '[A-Za-z0-9]'))""")
def V9_D23_dictionary_terms(spark, sf_dir):
    """A dictionary that grows with the benchmark, sought in all documents by one automaton."""
    return named(terms.find_dictionary(told_apart(spark, sf_dir), phrases(spark, sf_dir), "INTERNAL_TERM"))


def vocabulary(spark, sf_dir) -> DataFrame:
    """(piece, id) that we choose for these queries: the benchmark's words of letters, heads and tails of two letters of them, and all letters; numbered by their bytes."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    within = F.concat(F.lit(wordpiece.WITHIN), F.right("w", F.lit(2)))
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
    made = words.select(F.explode(F.array("w", F.left("w", F.lit(2)), within)).alias("piece"))
    every = spark.range(1).select(F.explode(F.flatten(F.array(F.array(F.lit("[UNK]"), F.lit("."), F.lit(",")), letters, F.transform(letters, lambda c: F.concat(F.lit(wordpiece.WITHIN), c))))).alias("piece"))
    numbered = made.unionByName(every).where(F.col("piece").isNotNull() & ~F.col("piece").isin("", wordpiece.WITHIN)).distinct()
    return numbered.withColumn("id", F.conv(F.substring(F.md5("piece"), 1, 12), 16, 10).cast("long"))


_VOCABULARY_SQL = """b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark),
l AS (SELECT unnest(regexp_extract_all('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '.')) AS c),
v AS (SELECT DISTINCT piece, CAST('0x' || substr(md5(piece), 1, 12) AS BIGINT) AS id, starts_with(piece, '##') AS within, CASE WHEN starts_with(piece, '##') THEN substr(piece, 3) ELSE piece END AS body FROM (
  SELECT w AS piece FROM b UNION SELECT left(w, 2) FROM b UNION SELECT '##' || right(w, 2) FROM b UNION SELECT c FROM l UNION SELECT '##' || c FROM l UNION SELECT unnest(['[UNK]', '.', ',']))),
longest AS (SELECT max(length(body)) AS most FROM v)"""
_ALONE_SQL = r"!-/:-@\[-`{-~\p{P}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2F800}-\x{2FA1F}"
_SPACE_SQL = r"\t\n\r\p{Zs}\x{2028}\x{2029}"


@query(rf"""WITH RECURSIVE {_VOCABULARY_SQL},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[{_ALONE_SQL}]|[^{_SPACE_SQL}{_ALONE_SQL}]+') AS words, regexp_split_to_array(text, '[{_ALONE_SQL}]|[^{_SPACE_SQL}{_ALONE_SQL}]+') AS gaps FROM documents WHERE text IS NOT NULL),
e AS (SELECT row, doc_id, words[i] AS word, i, sum(length(gaps[i]) + length(words[i])) OVER (PARTITION BY row ORDER BY i) - length(words[i]) AS cs FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d)),
u AS (SELECT DISTINCT word FROM e),
r AS (
  SELECT word, 0 AS place, 0 AS n, CAST(NULL AS BIGINT) AS id FROM u
  UNION ALL
  SELECT word, place + n, size, id FROM (
    SELECT r.word, r.place, r.n, arg_max(v.id, length(v.body)) AS id, max(length(v.body)) AS size
    FROM (SELECT *, unnest(range(1, (SELECT most FROM longest) + 1)) AS l FROM r WHERE place + n < length(word)) r JOIN v ON v.within = (r.place + r.n > 0) AND v.body = substr(r.word, r.place + r.n + 1, r.l) AND length(v.body) = r.l
    GROUP BY r.word, r.place, r.n)),
fine AS (SELECT word FROM r GROUP BY word HAVING max(place + n) = length(word) AND length(word) <= 100),
p AS (SELECT word, place, n, id FROM r JOIN fine USING (word) WHERE n > 0 UNION ALL SELECT word, 0, length(word), (SELECT id FROM v WHERE piece = '[UNK]') FROM u WHERE word NOT IN (SELECT word FROM fine))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY row ORDER BY i, p.place) - 1 AS INTEGER) AS "at", id, CAST(cs + p.place AS INTEGER) AS cs, CAST(cs + p.place + n AS INTEGER) AS ce FROM e JOIN p USING (word)""")
def V12_word_pieces(spark, sf_dir):
    return wordpiece.pieces(docs_of(spark, sf_dir), vocabulary(spark, sf_dir))


@query()
def V11_piece_windows(spark, sf_dir):
    return wordpiece.windows(docs_of(spark, sf_dir), vocabulary(spark, sf_dir))


# Table functions


@query(oracles.FIND_ALL)
def D0_sql_find_entities(spark, sf_dir):
    """All spans of all documents, asked for in SQL."""
    docs = docs_of(spark, sf_dir)
    tables.register(spark, docs, "veilworks_")
    docs.createOrReplaceTempView("veilworks_documents")
    return spark.sql("SELECT d.doc_id, e.cs, e.ce, e.type, e.detector, e.value FROM veilworks_documents d, LATERAL veilworks_find_entities(d.doc_id, d.text) e")


@query(oracles.POLICY)
def P1_sql_judged_texts(spark, sf_dir):
    """The decision on each document, asked for in SQL."""
    docs = docs_of(spark, sf_dir)
    tables.register(spark, docs, "veilworks_")
    docs.createOrReplaceTempView("veilworks_documents")
    return spark.sql("SELECT d.doc_id, e.n_spans, e.code, e.blocked_types FROM veilworks_documents d, LATERAL veilworks_judge_text(d.doc_id, d.text) e")
