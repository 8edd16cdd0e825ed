"""Queries of parts of texts, broken numbers, corpora and classifiers, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from veilworks.operators import answers, audit, context, detect, evidence, head, measure, parts, policy
from veilworks.plans import oracles
from veilworks.plans.evidence import PARTICLES, said, said_sql, trim_sql
from veilworks.plans.registry import CONTEXT_WORDS, audit_lines, docs_of, query, terms_sql
from veilworks.sources import corpora
from veilworks.sources.shared import shared_folder
from veilworks.sources.tables import table

#: Numbers that a line end breaks, after a word that explains them or another. Our own values.
WRAPPED = ("card 4111 1111\n1111 1111", "pay 4111 1111\n1111 1111", "전화 010-2345\n6789", "Tel: 010\n23456789 x", "면허 11-22\n333333-44", "주민 900101\n1234567", "card 4111\n1111\n1111 1111", "2024-01-02\n2024-01-03")
WRAPPED_SQL = said_sql(WRAPPED)
_BEFORE = "right(before || substr(run, 1, cs - run_at), {})"
_AFTER = "left(substr(run, ce - run_at + 1) || next, {})"
_OWN = "substr(run, cs - run_at + 1, ce - cs)"
_KEPT = f"(SELECT *, lower({_BEFORE.format(detect.CUE_REACH)}) AS ahead FROM ({oracles.windows(WRAPPED_SQL, detect.WRAPPED_RUNS, detect.CUE_REACH)}) WHERE contains({_OWN}, chr(10)))"
_CUED = " OR ".join(f"type = '{t}' AND regexp_matches(ahead, '{'|'.join(words)}')" for t, words in detect.CUES.items())


@query(f"SELECT DISTINCT doc_id, cs, ce, type, detector, value FROM ({oracles.numbers(found=f'SELECT * FROM {_KEPT}', keep=', ahead')}) WHERE {_CUED}")
def D7_wrapped_numbers(spark, sf_dir):
    return detect.find_wrapped(said(docs_of(spark, sf_dir), WRAPPED))


#: Numbers beside words that explain them, some of which are amounts or dates.
COUNTED = ("account 12345678", "account $ 12345678", "account 1234567 USD", "account 2024-02-30", "account 2024-02-29 ok", "account 2024.12.31", "token 300000원", "token 2024-01-02 2024-01-03", "password 123456")
COUNTED_SQL = said_sql(COUNTED)


@query(f"""WITH w AS (SELECT * FROM ({oracles.windows(COUNTED_SQL, around=8)}) WHERE length(digits) BETWEEN 6 AND 34 AND NOT regexp_matches({_BEFORE.format(8)}, {oracles.quoted(detect.AMOUNT_BEFORE)})
AND NOT regexp_matches({_AFTER.format(8)}, {oracles.quoted(detect.AMOUNT_AFTER)}) AND NOT regexp_matches({_OWN}, {oracles.quoted(detect.DATES)})), t AS ({terms_sql(CONTEXT_WORDS, 'CONTEXT').replace('FROM documents', 'FROM ' + COUNTED_SQL)})
SELECT DISTINCT doc_id, cs, ce, digits FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.cs - {context.NEAR} <= w.ce AND w.cs <= t.ce + {context.NEAR})""")
def D12_D13_accounts_in_context(spark, sf_dir):
    """Numbers near a word that explains them, which are neither amounts nor dates."""
    docs = said(docs_of(spark, sf_dir), COUNTED)
    return context.near(detect.countable(docs).where(F.length("digits").between(6, 34)).drop("shape"), detect.find_terms(docs, CONTEXT_WORDS, "CONTEXT"))


#: Numbers and addresses broken by markup. Our own values.
MARKED = ("id 900101\\text{-}1234567", "$4111{-}1111$ 1111\\,1111", "call 010#[-]2345#sym.dash 6789", "\\emph{ann}@mail.example.org", "host 10.0.\\-0.1 {}", "id 900101-123% note\n  4567 \\item", "100\\% of 4111-1111-1111-1111 #", "nothing")
MARKED_SQL = f"(SELECT doc_id, regexp_replace(text, {oracles.quoted(detect.MARKS)}, '\\1', 'g') AS text FROM {said_sql(MARKED)} WHERE regexp_matches(text, {oracles.quoted(detect.MARKED)}))"


@query(f"SELECT DISTINCT doc_id, type, detector, value FROM ({oracles.patterns(MARKED_SQL)} UNION ALL {oracles.numbers(MARKED_SQL)}) WHERE type IN ('EMAIL', 'IP_ADDRESS') OR detector IN ('Pattern', 'Checksum')")
def V3_marked_spans(spark, sf_dir):
    return detect.find_marked(said(docs_of(spark, sf_dir), MARKED)).select("doc_id", "type", "detector", "value").distinct()


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS words, regexp_split_to_array(text, '[^ \\t\\r\\n]+') AS gaps FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(words) AS n, [i for i in range(0, len(words) - 1) if regexp_matches(words[i + 1], '[.?!。]$') OR regexp_matches(gaps[i + 2], '[\\r\\n]')] AS cuts FROM c WHERE len(words) > 0),
w AS (SELECT doc_id, n, cuts, 0 AS "at", 0 AS first, least(n, {parts.BODY}) AS lim, [x for x in cuts if x < least(n, {parts.BODY})][-1] AS last FROM d
UNION ALL SELECT doc_id, n, cuts, "at" + 1, s, least(n, s + {parts.BODY}), [x for x in cuts if x < least(n, s + {parts.BODY})][-1] FROM (SELECT *, CASE WHEN last >= first THEN last + 1 ELSE lim - {parts.OVERLAP} END AS s FROM w WHERE lim < n))
SELECT doc_id, CAST("at" AS INTEGER) AS "at", CAST(first AS INTEGER) AS first, CAST(CASE WHEN lim = n THEN n WHEN last >= first THEN last + 1 ELSE lim END AS INTEGER) AS "end", count(*) OVER (PARTITION BY doc_id) > {parts.MOST_WINDOWS} AS overloaded FROM w""")
def V11_token_windows(spark, sf_dir):
    """Windows over words."""
    return parts.token_windows(docs_of(spark, sf_dir), *parts.words_and_cuts(F.col("text")))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha FROM documents WHERE text <> ''")
def V10_blocks(spark, sf_dir):
    """What blocks of bytes add up to; tests hold each block against its rule."""
    found = parts.blocks(docs_of(spark, sf_dir)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("b"))
    whole = F.array_join(F.transform("b", lambda b: b["text"]), "")
    return found.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))


@query()
def A21_softmax_head(spark, sf_dir):
    """A head that learns the labels of four fifths of the vectors judges all."""
    vectors = table(spark, sf_dir, "embeddings")
    return head.scored(head.fitted(vectors.where("vec_id % 5 <> 0"), "embedding", "label"), vectors, "embedding")


@query("SELECT coalesce(source, '-') AS \"group\", count(*) FILTER (WHERE doc_id % 10 <> 0) AS n_items, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_damaged FROM documents GROUP BY ALL")
def S23_corpus_entries(spark, sf_dir):
    """Documents as files of a corpus, one in ten of them broken off."""
    made = F.to_json(F.struct(F.array(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("data")))
    files = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("path"), F.when(F.col("doc_id") % 10 == 0, F.left(made, F.length(made) - 2)).otherwise(made).alias("content"))
    return corpora.damaged(corpora.entries(files, "data array<struct<doc_id: bigint, text: string>>", "data"), F.col("path"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS chain, count(*) AS n_lines, 'ok' AS verdict FROM events GROUP BY ALL")
def K4_audit_files(spark, sf_dir):
    """Audit lines, appended to files and verified as read."""
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    corpora.append_lines(audit.chained(audit_lines(spark, sf_dir)), folder)
    return audit.verified(corpora.read_lines(spark, folder))


@query(f"""WITH {oracles.SPANS}, l AS (SELECT s.doc_id, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM acted s WHERE strength > 1 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.action = 'tokenize' AND m.doc_id = s.doc_id AND m.cs <= s.cs AND s.ce <= m.ce) GROUP BY s.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id), c AS (SELECT d.doc_id, CASE WHEN n > {policy.MOST_SPANS} THEN 203 WHEN l.types IS NOT NULL THEN 403 END AS code, l.types FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, code, CASE WHEN code = 403 THEN types ELSE '' END AS types FROM c""")
def P8_residual_codes(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    spans = detect.find_all(docs)
    return policy.residual_codes(docs, spans, policy.targets(policy.merge(spans)))


#: How long a token can be restored.
SECONDS = 3600


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 502 END AS code, CASE WHEN doc_id % 3 = 0 THEN '⟦EMAIL_0123456789⟧ ' || doc_id ELSE 'mail ' || doc_id END AS text FROM documents")
def R6_expired_tokens(spark, sf_dir):
    """Answers with a token each, a third of which come when it is too late."""
    k, token = F.col("doc_id"), F.lit("⟦EMAIL_0123456789⟧")
    start = F.lit("2024-01-01").cast("timestamp")
    given = table(spark, sf_dir, "documents").select(k, F.concat(token, F.lit(" "), k.cast("string")).alias("text"), (start + F.make_dt_interval(secs=F.when(k % 3 == 0, SECONDS).otherwise(SECONDS - 1))).alias("asked"))
    issued = given.select("doc_id", token.alias("token"), F.lit("mail").alias("value"), start.alias("issued"))
    return answers.restored(given.select("doc_id", "text"), answers.alive(issued, given, SECONDS)).select("doc_id", "code", "text")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS uid FROM (SELECT source, min(doc_id) AS doc_id FROM documents WHERE length(trim(text)) >= 4 GROUP BY source, sha256(trim(text)))")
def A13_numbered_copies(spark, sf_dir):
    return measure.numbered(measure.first_copies(table(spark, sf_dir, "documents"), "source", "doc_id", "text"), "source", "doc_id")


@query("SELECT doc_id, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'missing' ELSE 'differs' END AS verdict FROM labels WHERE quality IS NULL OR toxic IS NULL OR quality <> toxic")
def A16_disagreements(spark, sf_dir):
    return measure.disagreements(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


_RUNS = "SELECT event_type AS config, user_id % 5 AS seed, avg(value) AS score, length(event_type) AS size FROM events GROUP BY ALL"


@query(f"""WITH r AS ({_RUNS}), c AS (SELECT config, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS sd, max(size) AS size FROM r GROUP BY config HAVING bool_and(score > 0)),
o AS (SELECT *, lead(mean) OVER w AS mean2, lead(sd) OVER w AS sd2, row_number() OVER w AS r FROM c WINDOW w AS (ORDER BY mean DESC, size, config))
SELECT config, mean, sd, CAST(size AS INTEGER) AS size, abs(mean - mean2) > 2 * greatest(sd, sd2) AS differs FROM o WHERE r = 1""")
def A17_chosen_configuration(spark, sf_dir):
    """Event types as configurations, users in five groups as seeds."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("score")).withColumn("size", F.length("config"))
    return measure.chosen(runs, "config", "score", "size", F.col("score") > 0)


@query(f"""WITH r AS ({_RUNS}) SELECT seed, round(avg(score) FILTER (WHERE config = 'click'), 6) AS click, round(avg(score) FILTER (WHERE config = 'purchase'), 6) AS purchase, round(min(score), 6) AS least, count(*) FILTER (WHERE score > 100) AS passed FROM r GROUP BY seed""")
def A18_pivot(spark, sf_dir):
    """A row for each seed, two configurations as columns, the least of all, and how many pass."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("score"))
    wide = runs.groupBy("seed").pivot("config", ["click", "purchase"]).agg(F.round(F.avg("score"), 6))
    return wide.join(runs.groupBy("seed").agg(F.round(F.min("score"), 6).alias("least"), F.count_if(F.col("score") > 100).alias("passed")), "seed")


#: Licences of both forms, and near misses. Our own values.
LICENCES = ("면허 112233333344 x", "number 112233333344", "서울 95-255933-61", "부산9525593361", "면허 992233333344", "서울 1-95-255933-61", "면허 11-22-333333-44")
LICENCES_SQL = said_sql(LICENCES)
_AHEAD = _BEFORE.format(detect.LICENCE_REACH)


@query(f"""WITH w AS (SELECT *, {_AHEAD} AS ahead FROM ({oracles.windows(LICENCES_SQL, around=detect.LICENCE_REACH)})), n AS (SELECT *, regexp_extract(ahead, '((?:{'|'.join(detect.REGIONS)}) ?)$', 1) AS named FROM w),
o AS (SELECT *, length(digits) = 10 AND cs = run_at AND named <> '' AS old FROM n)
SELECT doc_id, CAST(CASE WHEN old THEN cs - length(named) ELSE cs END AS INTEGER) AS cs, ce, 'KOREAN_DRIVER_LICENSE_NO' AS type, 'Pattern' AS detector, digits AS value FROM o
WHERE old OR (shape = '12' AND left(digits, 2) BETWEEN '11' AND '28' AND contains(ahead, '{detect.LICENCE_WORD}'))""")
def D5_licences(spark, sf_dir):
    return detect.find_licences(said(docs_of(spark, sf_dir), LICENCES))


#: Legal forms, our own, and texts with them.
SHORT, FORMS = ["(Ltd)", "㈜"], ["Company", "회사"]
FORMED = ("the (Ltd)Northern here", "㈜한빛은 또", "Company  Quill, and", "회사 새봄에서는", "Companyman Quill", "Company X", "(Ltd) Northern", "nothing")
FORMED_SQL = said_sql(FORMED)
_SIDES = [re.escape(s) for s in SHORT] + [f"(?:^|[^{evidence.WORD}]){f}[^{evidence.WORD}]+" for f in FORMS]
_WORDS = " UNION ".join(f"SELECT doc_id, cs, {trim_sql('value')} AS own FROM ({oracles.matches('form', f'{side}([{evidence.WORD}]+)', FORMED_SQL)})" for side in _SIDES)


@query(f"SELECT DISTINCT doc_id, cs, CAST(cs + length(own) AS INTEGER) AS ce, 'ORGANIZATION' AS type, 'Pattern' AS detector, own AS value FROM ({_WORDS}) WHERE length(own) >= 2")
def D24_named_by_form(spark, sf_dir):
    return evidence.find_named_by_form(said(docs_of(spark, sf_dir), FORMED), SHORT, FORMS, PARTICLES)
