"""Queries of what stands around spans, with their SQL: clauses, sentences, organizations, persons; comparisons of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators import answers, context, detect, evidence, exemplars, ledger, policy, texts
from veilworks.plans import oracles
from veilworks.plans.registry import CONTEXT_WORDS, PLANTED, docs_of, planted, query, terms_sql
from veilworks.sources.shared import cut
from veilworks.sources.tables import table



def said(docs: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Documents with one of `ends` after them."""
    own = F.get(F.array(*map(F.lit, ends)), (F.col("doc_id") % len(ends)).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" | "), own).alias("text"))


def said_sql(ends: tuple[str, ...]) -> str:
    return f"(SELECT doc_id, coalesce(text, '') || ' | ' || list_value({', '.join(map(oracles.quoted, ends))})[doc_id % {len(ends)} + 1] AS text FROM documents)"


#: Numbers and words that explain them, in one clause and in two.
EXPLAINED = ("account 12345678 now", "account no. 12345678 now", "account 9! 12345678 now", "token 77? 12345678 x", "server 5. 12345678", "nothing 12345678")
EXPLAINED_SQL = said_sql(EXPLAINED)
WORDS_SQL = f"({terms_sql(CONTEXT_WORDS, 'CONTEXT').replace('FROM documents', 'FROM ' + EXPLAINED_SQL)})"
CLAUSES_SQL = f"(SELECT doc_id, ce FROM ({oracles.matches('mark', evidence.CLAUSE_MARKS, EXPLAINED_SQL)}) WHERE regexp_matches(next, '^[ \\t\\n]') AND NOT (value = '.' AND regexp_matches(before, '[A-Za-z]$')))"


def ends_sql(source: str = "documents") -> str:
    return f"(SELECT doc_id, ce FROM ({oracles.matches('mark', evidence.SENTENCE_MARKS, source)}) WHERE value = chr(10) OR next = '' OR regexp_matches(next, '^[ \\t\\r\\n]'))"


def number_sql(spans: str, ends: str, name: str) -> str:
    """spans with how many of ends come before each, by counting."""
    return f"(SELECT s.*, CAST(count(e.ce) AS INTEGER) AS {name} FROM (SELECT *, row_number() OVER () AS row_ FROM {spans}) s LEFT JOIN {ends} e ON e.doc_id = s.doc_id AND e.ce <= s.cs GROUP BY ALL)"


@query(f"SELECT doc_id, cs, ce, digits, clause FROM {number_sql(f'({oracles.windows(EXPLAINED_SQL)})', CLAUSES_SQL, 'clause')}")
def V8_clause_numbers(spark, sf_dir):
    """The clause of each digit window."""
    docs = said(docs_of(spark, sf_dir), EXPLAINED)
    return evidence.numbered(detect.digit_windows(docs).drop("shape"), evidence.clause_ends(docs), "clause")


@query(f"""WITH w AS (SELECT * FROM {number_sql(f'(SELECT * FROM ({oracles.windows(EXPLAINED_SQL)}) WHERE length(digits) >= 6)', CLAUSES_SQL, 'clause')}), t AS (SELECT * FROM {number_sql(WORDS_SQL, CLAUSES_SQL, 'clause')})
SELECT DISTINCT doc_id, cs, ce, digits FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.clause = w.clause AND t.cs - {context.NEAR} <= w.ce AND w.cs <= t.ce + {context.NEAR})""")
def D12_V8_numbers_in_clause(spark, sf_dir):
    """Numbers near a word that explains them in the same clause."""
    docs = said(docs_of(spark, sf_dir), EXPLAINED)
    ends = evidence.clause_ends(docs)
    numbers = evidence.numbered(detect.digit_windows(docs).where(F.length("digits") >= 6).drop("shape"), ends, "clause")
    words = evidence.numbered(detect.find_terms(docs, CONTEXT_WORDS, "CONTEXT"), ends, "clause")
    return context.near(numbers, words, same=("clause",)).drop("clause")


#: Our own words of organizations, what may follow them, and texts with and without one.
TAILS, GENERIC = ["Institute", "Bank", "은행", "연구소"], ["the", "our", "우리", "a"]
PARTICLES = [("은", "final"), ("는", "open"), ("에서", ""), ("의", ""), ("을", "final"), ("에서는", "")]
NAMED = ("met at NorthBank today", "한빛은행에서는 안내", "우리은행의 공지", "새봄연구소는 오늘", "theBank closed", "lowerbank and Bank", "Q7Institute, then X9Bank", "강은행을 가", "한빛은행은 또", "no name here")
NAMED_SQL = said_sql(NAMED)


def trim_sql(word: str, rounds: int = 2, particles: list[tuple[str, str]] = PARTICLES) -> str:
    """A word less its particles, by a pattern for each."""
    for _ in range(rounds):
        cases = []
        for text, kind in sorted(particles, key=lambda p: (-len(p[0]), p[0])):
            rest = f"left({word}, length({word}) - {len(text)})"
            code = f"(unicode(right({rest}, 1)) - 44032)"
            need = {"final": f" AND {code} BETWEEN 0 AND 11171 AND {code} % 28 <> 0", "open": f" AND {code} BETWEEN 0 AND 11171 AND {code} % 28 = 0", "": ""}[kind]
            cases.append(f"WHEN suffix({word}, '{text}') AND length({word}) >= {len(text) + 2}{need} THEN {rest}")
        word = f"(CASE {' '.join(cases)} ELSE {word} END)"
    return word


@query(f"""WITH m AS ({oracles.matches('word', f"(?:^|[^{evidence.WORD}])([{evidence.WORD}]*(?:{'|'.join(TAILS)})[{evidence.WORD}]*)", NAMED_SQL)}), o AS (SELECT doc_id, cs, {trim_sql('value')} AS own FROM m),
h AS (SELECT *, regexp_extract(own, '^(.*?)(?:{'|'.join(TAILS)})$', 1) AS head FROM o)
SELECT doc_id, cs, CAST(cs + length(own) AS INTEGER) AS ce, 'ORGANIZATION' AS type, 'Pattern' AS detector, own AS value FROM h
WHERE head <> '' AND lower(head) NOT IN ({', '.join(map(oracles.quoted, GENERIC))}) AND CASE WHEN regexp_matches(head, '^[A-Za-z0-9&]+$') THEN regexp_matches(head, '[A-Z0-9]') ELSE length(head) >= 2 END""")
def D24_V13_organizations(spark, sf_dir):
    return evidence.find_organizations(said(docs_of(spark, sf_dir), NAMED), TAILS, GENERIC, PARTICLES)


#: Our own words of categories, and the types that tell of a person.
CATEGORIES = {"Access": ["password", "token", "call", "key"], "Legal": ["license", "court", "case no", "law"]}
IDENTITIES = ["EMAIL", "KOREAN_PHONE", "IP_ADDRESS", "KOREAN_RRN"]
_HITS = " UNION ALL ".join(f"SELECT doc_id, cs, ce, '{c}' AS category FROM ({terms_sql(t, c).replace('FROM documents', 'FROM ' + PLANTED)})" for c, t in CATEGORIES.items())
SENSITIVE_SQL = f"""WITH {oracles.spans_of(PLANTED)}, c AS (SELECT DISTINCT doc_id, sentence, category FROM {number_sql(f'({_HITS})', ends_sql(PLANTED), 'sentence')}),
p AS (SELECT DISTINCT doc_id, sentence FROM {number_sql(f"(SELECT * FROM spans WHERE type IN ({', '.join(map(oracles.quoted, IDENTITIES))}))", ends_sql(PLANTED), 'sentence')}),
b AS (SELECT DISTINCT c.doc_id, least(c.sentence, p.sentence) AS first, greatest(c.sentence, p.sentence) AS last FROM c JOIN p ON c.doc_id = p.doc_id AND abs(c.sentence - p.sentence) <= 1)"""


def sensitive_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Words of categories and spans of persons, with the number of their sentence."""
    docs = planted(docs_of(spark, sf_dir))
    words = reduce(DataFrame.unionByName, [detect.find_terms(docs, terms, c) for c, terms in CATEGORIES.items()]).withColumnRenamed("type", "category")
    ends = evidence.sentence_ends(docs)
    persons = detect.find_all(docs).where(F.col("type").isin(*IDENTITIES))
    hits = words.select("doc_id", "cs", "category").unionByName(persons.select("doc_id", "cs", F.lit(None).cast("string").alias("category")))
    found = cut(evidence.numbered(hits, ends, "sentence").select("doc_id", "sentence", "category").distinct())  # both are read twice
    return found.where("category IS NOT NULL"), found.where("category IS NULL").select("doc_id", "sentence")


@query(f"{SENSITIVE_SQL} SELECT * FROM b")
def D29_J1_sensitive_sentences(spark, sf_dir):
    return evidence.sensitive(*sensitive_hits(spark, sf_dir))


@query(f"""{SENSITIVE_SQL} SELECT category, least(count(*), {evidence.MOST_TALLY}) AS n FROM c
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND c.sentence BETWEEN b.first AND b.last) GROUP BY category""")
def D30_sensitive_tally(spark, sf_dir):
    words, persons = sensitive_hits(spark, sf_dir)
    return evidence.uncovered(words, evidence.sensitive(words, persons))


KINDS, FLOORS = ["Personal", "Money", "Credential"], [0.27, 0.3, 0.26]


@query(f"""WITH e AS (SELECT label AS doc_id, vec_id, vec_id % 3 <> 0 AS personal, [exp(CAST(x AS DOUBLE)) for x in embedding[1:4]] AS e FROM embeddings),
p AS (SELECT doc_id, personal, [round(x / list_sum(e), 9) for x in e[1:3]] AS p FROM e),
t AS (SELECT *, list_position(p, list_max(p)) AS k, list_max(p) AS score FROM p),
v AS (SELECT doc_id, {KINDS!r}[k] AS category, score FROM t WHERE score >= {FLOORS!r}[k] AND (personal OR k = 3))
SELECT doc_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category DESC) AS r FROM v) WHERE r = 1""")
def D33_scored_documents(spark, sf_dir):
    """Four components of vectors as a classifier's scores of windows, labels as documents."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return evidence.scored(e.select(F.col("label").alias("doc_id"), (F.col("vec_id") % 3 != 0).alias("personal"), logits.alias("logits")), KINDS, FLOORS, ["Credential"])


MARKERS = ["customer", "Mr."]
REFERENCES = [(a, b) for a in ("my", "his", "this") for b in ("brother", "person", "file")]
SPOKEN = ("see my brother's car", "of (his person)", "of mymy brother", "dear customer,", "this file.", "Mr. X", "of his files", "nobody")
LEFT, RIGHT, AFTER = " \n(", " .,)\n", ["'s"]


@query(f"""WITH r AS (SELECT a.w || ' ' || b.w AS ref FROM (VALUES ('my'), ('his'), ('this')) a(w), (VALUES ('brother'), ('person'), ('file')) b(w))
SELECT doc_id, contains(text, 'customer') OR contains(text, 'Mr.') OR EXISTS (SELECT 1 FROM r WHERE regexp_matches(text, '(^|[ \\n(])' || ref || '([ .,)\\n]|''s|$)')) AS personal FROM {said_sql(SPOKEN)}""")
def D34_person_references(spark, sf_dir):
    personal = evidence.refers_to_person(F.col("text"), MARKERS, REFERENCES, LEFT, RIGHT, AFTER)
    return said(docs_of(spark, sf_dir), SPOKEN).select("doc_id", personal.alias("personal"))


# Bytes and forms


@query("SELECT doc_id, doc_id % 4 = 2 AS valid FROM documents WHERE text IS NOT NULL")
def V1_utf8(spark, sf_dir):
    """Texts as bytes: whole, or with an overlong form, a surrogate or a code point past the last at the end."""
    ends = F.array(*(F.unhex(F.lit(h)) for h in ("C0AF", "EDA080", "C3A9", "F4908080")))
    docs = docs_of(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", texts.valid(F.concat(F.encode("text", "UTF-8"), F.get(ends, (F.col("doc_id") % 4).cast("int")))).alias("valid"))


@query("SELECT doc_id, sha256(nfc_normalize(regexp_replace(text || ' cafe' || chr(769) || chr(8203), '[​-‍﻿]', '', 'g'))) AS sha FROM documents WHERE text IS NOT NULL")
def V16_comparable_texts(spark, sf_dir):
    """Texts with a decomposed letter and an invisible mark at the end, as they are compared."""
    docs = docs_of(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", F.sha2(texts.comparable(F.concat("text", F.lit(" café​"))), 256).alias("sha"))


# Comparisons


LINES_SQL = f"(SELECT doc_id || ':' || line AS doc_id, text FROM ({oracles.LINES.replace('FROM documents', 'FROM ' + PLANTED)}))"


@query(f"""WITH w AS (SELECT type, count(*) AS whole FROM (WITH {oracles.spans_of(PLANTED)} SELECT * FROM spans) GROUP BY type), b AS (SELECT type, count(*) AS blocks FROM (WITH {oracles.spans_of(LINES_SQL)} SELECT * FROM spans) GROUP BY type)
SELECT coalesce(w.type, b.type) AS type, coalesce(whole, 0) AS whole, coalesce(blocks, 0) AS blocks FROM w FULL JOIN b ON w.type = b.type""")
def A32_block_baseline(spark, sf_dir):
    """Spans by type in whole documents, and in their lines one by one."""
    docs = planted(docs_of(spark, sf_dir))
    lines = texts.lines(docs).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("doc_id"), "text")
    count = lambda d, name: detect.find_all(d).groupBy("type").agg(F.count(F.lit(1)).alias(name))
    return count(docs, "whole").join(count(lines, "blocks"), "type", "full_outer").select("type", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


#: A span right after one that is replaced, and one apart from it.
ADJOINED = ("mail ann@mail.example.org-----BEGIN PRIVATE KEY-----abc", "card 4111 1111 1111 1111 of ann@mail.example.org", "mail ann@mail.example.org")
_COPY = f"({oracles.rewritten(f"'⟦' || label || '_{policy.FILLER}⟧'", said_sql(ADJOINED))})"


@query(f"""WITH {oracles.spans_of(_COPY)}, k AS (SELECT doc_id, cs AS k_cs, ce AS k_ce FROM ({oracles.matches('token', f'({answers.TOKEN})', _COPY)}))
SELECT s.doc_id, s.cs, s.ce, s.type, s.detector, bool_or(k_cs IS NOT NULL) AS touches FROM spans s LEFT JOIN k ON k.doc_id = s.doc_id AND s.cs <= k_ce AND k_cs <= s.ce
GROUP BY ALL HAVING NOT coalesce(bool_or(k_cs <= s.cs AND s.ce <= k_ce), false)""")
def A33_residual_touches(spark, sf_dir):
    """Spans of the second scan that lie in no token, and whether they touch one."""
    docs = said(docs_of(spark, sf_dir), ADJOINED)
    copy = policy.rewrite(docs, policy.merge(detect.find_all(docs)), "filler")
    return policy.touching(detect.find_all(copy), detect.matches(copy, {"token": (f"({answers.TOKEN})", "⟦")}))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id AS x_id, label AS x_label, v AS x FROM e WHERE vec_id % 50 = 0), n AS (SELECT v AS x FROM e WHERE vec_id % 50 = 1),
s AS (SELECT vec_id, x_label AS guess, list_sum([a[1] * a[2] for a in list_zip(v, x)]) AS dot FROM e, x), t AS (SELECT vec_id, guess, avg(dot) AS top FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, guess ORDER BY dot DESC) AS r FROM s) WHERE r <= 3 GROUP BY ALL),
m AS (SELECT vec_id, max(list_sum([a[1] * a[2] for a in list_zip(v, x)])) AS most FROM e, n GROUP BY vec_id)
SELECT vec_id, guess, round(top - most, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(top, 9) DESC, guess) AS r FROM t) JOIN m USING (vec_id) WHERE r = 1""")
def A19_exemplars(spark, sf_dir):
    """Vectors scored against stated exemplars and negatives."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return exemplars.scored(e.drop("label"), e.where("vec_id % 50 = 0").select("label", "v"), e.where("vec_id % 50 = 1").select("v"))


@query()
def T3_vault_scopes(spark, sf_dir):
    """Events of a user as what is done to a scope of its own."""
    e = table(spark, sf_dir, "events")
    turn = F.pmod("event_id", F.lit(7))
    action = F.when(turn < 2, "create").when(turn < 4, "issue").when(turn < 6, "resolve").otherwise("drop")
    return ledger.scopes(e.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("id"), "ts", action.alias("action"), F.col("event_type").alias("value"), F.lit(86_400 * 3).alias("seconds")))
