"""More queries by name, with their SQL: measurements, bodies, limits and files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators import answers, audit, detect, links, measure, reports
from veilworks.plans import oracles
from veilworks.plans.registry import IN_FLIGHT_SECONDS, PLANTED, PLANTS, audit_lines, docs_of, labelled, planted, query
from veilworks.sources import bodies, files
from veilworks.sources.tables import table

#: The type that each of PLANTS is of, or none.
OWN = {0: "KOREAN_PHONE", 3: "KOREAN_BUSINESS_NO", 4: "CARD_NUMBER", 8: "BANK_ACCOUNT", 12: "EMAIL", 13: "IP_ADDRESS", 16: "API_KEY", 21: "CREDENTIAL", 10: "KOREAN_DRIVER_LICENSE_NO", 33: None, 5: None}
OWN_SQL = "(VALUES " + ", ".join(f"({k}, {oracles.quoted(v) if v else 'NULL'})" for k, v in OWN.items()) + ") o(k, own)"
VERDICTS = f"""WITH {oracles.spans_of(PLANTED)}, t AS (SELECT doc_id, list(DISTINCT type) AS types FROM spans GROUP BY doc_id)
SELECT d.doc_id, own, CASE WHEN own IS NULL THEN len(coalesce(types, [])) > 0 ELSE list_contains(coalesce(types, []), own) END AS blocked,
own IS NOT NULL AND NOT list_contains(coalesce(types, []), own) AND len(coalesce(types, [])) > 0 AS other FROM documents d JOIN {OWN_SQL} ON doc_id % {len(PLANTS)} = k LEFT JOIN t ON d.doc_id = t.doc_id"""


def verdicts(spark, sf_dir) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    own = spark.createDataFrame(list(OWN.items()), "k long, own string")
    samples = docs.join(F.broadcast(own), F.col("doc_id") % len(PLANTS) == F.col("k")).select("doc_id", "own")  # eleven rows
    return reports.rule_verdicts(samples, detect.find_all(planted(docs)))


@query(VERDICTS)
def A4_rule_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query(f"SELECT coalesce(own, 'none') AS own, count(*) AS n, count(*) FILTER (WHERE blocked) AS k, count(*) FILTER (WHERE other) AS other, round(100 * count(*) FILTER (WHERE blocked) / count(*), 6) AS rate FROM ({VERDICTS}) GROUP BY 1")
def A5_rates_by_category(spark, sf_dir):
    k = F.count_if("blocked")
    return verdicts(spark, sf_dir).groupBy(F.coalesce("own", F.lit("none")).alias("own")).agg(F.count(F.lit(1)).alias("n"), k.alias("k"), F.count_if("other").alias("other"), F.round(100 * k / F.count(F.lit(1)), 6).alias("rate"))


WANTED = [("de", 5.0, 15.0), ("en", 0.0, 50.0), ("es", 0.0, 1.0), ("xx", 0.0, 1.0)]


@query(f"""WITH r AS (SELECT lang, 100 * count(*) FILTER (WHERE toxic = 1) / count(*) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang),
e AS (SELECT w.lang, round(rate, 6) AS rate, coalesce(round(rate, 6) BETWEEN lo AND hi, false) AS holds FROM (VALUES {', '.join(map(str, WANTED))}) w(lang, lo, hi) LEFT JOIN r ON w.lang = r.lang) SELECT *, (SELECT bool_and(holds) FROM e) AS all_hold FROM e""")
def A8_criteria(spark, sf_dir):
    wanted = spark.createDataFrame(WANTED, "lang string, least double, most double")
    return reports.criteria(measure.rates(labelled(spark, sf_dir), ["lang"], F.col("toxic") == 1).select("lang", "rate"), wanted, "lang")


def any_spans(source: str) -> str:
    return f"SELECT DISTINCT doc_id FROM (WITH {oracles.spans_of(source)} SELECT * FROM spans)"


VARIANTS = {"at": "replace(text, '@', ' at ')", "prefix": "'Note: ' || text"}


@query("SELECT axis, count(*) AS n, count(*) FILTER (WHERE a <> b) AS flipped, count(*) FILTER (WHERE NOT a AND b) AS added, round(count(*) FILTER (WHERE a <> b) / count(*), 9) AS flip_rate FROM ("
       + " UNION ALL ".join(f"SELECT '{axis}' AS axis, d.doc_id IN ({any_spans('documents')}) AS a, d.doc_id IN ({any_spans(f'(SELECT doc_id, {said} AS text FROM documents)')}) AS b FROM documents d" for axis, said in VARIANTS.items()) + ") GROUP BY axis")
def A9_A37_shortcut_axes(spark, sf_dir):
    """Whether what a detector says of a text changes with changes that shouldn't matter, or should."""
    docs = docs_of(spark, sf_dir)
    caught = lambda d, name: detect.find_all(d).select("doc_id").distinct().withColumn(name, F.lit(True))
    before, pairs = docs.select("doc_id").join(caught(docs, "before"), "doc_id", "left"), None
    for axis, said in VARIANTS.items():
        one = before.join(caught(docs.select("doc_id", F.expr(said).alias("text")), "after"), "doc_id", "left").fillna(False).select(F.lit(axis).alias("axis"), "before", "after")
        pairs = one if pairs is None else pairs.unionByName(one)
    return reports.flips(pairs)


POISSON = " + ".join(f"CAST(u >= {p} AS INTEGER)" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253))


@query(f"""SELECT replicate, CAST(sum(w) AS BIGINT) AS n, round(CAST(sum(w * toxic) AS DOUBLE) / sum(w), 9) AS rate FROM (SELECT replicate, toxic, {POISSON} AS w FROM (
SELECT toxic, CAST(k AS INTEGER) AS replicate, CAST(('0x' || substr(sha256('7:' || k || ':' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM labels, range(10) r(k))) WHERE w > 0 GROUP BY replicate""")
def A22_bootstrap(spark, sf_dir):
    return reports.bootstrap(table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1, 10, "7")


@query(f"""WITH p AS (SELECT doc_id, type, value, count(*) AS p FROM (WITH {oracles.spans_of()} SELECT * FROM spans) GROUP BY ALL), g AS (SELECT doc_id, type, value, count(*) AS g FROM (WITH {oracles.spans_of(PLANTED)} SELECT * FROM spans) GROUP BY ALL),
b AS (SELECT coalesce(p.type, g.type) AS type, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.type = g.type AND p.value = g.value),
s AS (SELECT type, CAST(sum(least(p, g)) AS BIGINT) AS matched, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(g) AS BIGINT) AS gold FROM b GROUP BY type)
SELECT *, CASE WHEN predicted = 0 THEN 1.0 ELSE round(CAST(matched AS DOUBLE) / predicted, 9) END AS precision, CASE WHEN gold = 0 THEN 1.0 ELSE round(CAST(matched AS DOUBLE) / gold, 9) END AS recall FROM s""")
def A26_A35_J10_multiset_scores(spark, sf_dir):
    """Spans of the documents against those of the same documents with more in them."""
    docs = docs_of(spark, sf_dir)
    return reports.multiset_scores(detect.find_all(docs), detect.find_all(planted(docs)))


KINDS = ["click", "error", "purchase"]


@query("SELECT user_id, min(ts) AS since, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}, arg_max(value, {{'a': ts, 'b': event_id}}) FILTER (WHERE event_type = '{k}') AS last_{k}" for k in KINDS) + " FROM events GROUP BY user_id")
def A31_regrouped_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")
    return reports.regrouped(rows, "user_id", KINDS)


@query("""WITH w AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS s FROM events)
SELECT event_type, CAST(0.95 AS DOUBLE) AS q, x[CAST(least(n - 1, floor(0.95 * n)) AS BIGINT) + 1] AS quantile FROM (SELECT event_type, list_sort(list(round(s, 3))) AS x, count(*) AS n FROM w WHERE s IS NOT NULL GROUP BY event_type)""")
def A34_latencies(spark, sf_dir):
    waits = reports.waits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return measure.nearest_rank(waits.withColumn("seconds", F.round("seconds", 3)), ["event_type"], "seconds", 0.95)


GRID = [0.0, 5.0, 20.0, 50.0, 100.0]


@query(f"SELECT t AS threshold, count(*) AS n, count(*) FILTER (WHERE value >= t AND event_type = 'error') AS caught, count(*) FILTER (WHERE value >= t AND event_type <> 'error') AS wrong FROM events, (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS t) GROUP BY t")
def A36_threshold_sweep(spark, sf_dir):
    return reports.swept(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error", GRID)


def sweep_sql(limit: int) -> str:
    return f"""WITH m AS (SELECT event_type AS key, event_id AS id, ts, 1 AS move FROM events UNION ALL SELECT event_type, event_id, ts + INTERVAL {IN_FLIGHT_SECONDS} SECOND, -1 FROM events),
r AS (SELECT *, sum(move) OVER (PARTITION BY key ORDER BY ts, move, id ROWS UNBOUNDED PRECEDING) AS running FROM m) SELECT key, id, ts, CAST(running AS BIGINT) AS running, running > {limit} AS overloaded FROM r WHERE move = 1"""


def starts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts")


@query(sweep_sql(2))
def T12_two_at_once(spark, sf_dir):
    return audit.in_flight(starts(spark, sf_dir), IN_FLIGHT_SECONDS, limit=2)


@query(f"SELECT key, CASE WHEN overloaded THEN 'overloaded' ELSE 'ok' END AS outcome, count(*) AS n FROM ({sweep_sql(16)}) GROUP BY ALL")
def A38_outcomes(spark, sf_dir):
    swept = audit.in_flight(starts(spark, sf_dir), IN_FLIGHT_SECONDS)
    return swept.groupBy("key", F.when(F.col("overloaded"), "overloaded").otherwise("ok").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT count(*) AS n FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS chain FROM events) WHERE date_diff('day', CAST(chain AS DATE), DATE '2025-06-15') > 365) SELECT n FROM c")
def T6_expired_chains(spark, sf_dir):
    points = audit.checkpoints(audit.chained(audit_lines(spark, sf_dir)))
    return audit.expired(points, "2025-06-15").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {oracles.spans_of(PLANTED)}, s AS (SELECT doc_id, cs, max(ce) AS ce FROM spans WHERE type = 'EMAIL' GROUP BY ALL)
SELECT d.doc_id, CASE WHEN s.cs IS NULL THEN d.text ELSE substr(d.text, 1, s.cs) || 'OOO' || substr(d.text, s.ce + 1) END AS text FROM {PLANTED} d LEFT JOIN (SELECT doc_id, min(cs) AS cs, min(ce) AS ce FROM s GROUP BY doc_id HAVING count(*) = 1) s ON d.doc_id = s.doc_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) > 1)""")
def P11_masked_persons(spark, sf_dir):
    """Mail addresses masked, of the documents with one at most."""
    docs = planted(docs_of(spark, sf_dir))
    spans = detect.find_all(docs).where("type = 'EMAIL'")
    several = spans.groupBy("doc_id").agg(F.count_distinct("cs").alias("n")).where("n > 1")
    return reports.masked_persons(docs.join(several, "doc_id", "left_anti"), spans)


ANSWER = "'Dear ⟦EMAIL_0123456789⟧, see ⟦PERSON_ABCDEFGHJK⟧ ⟦bad_1⟧ ' || doc_id"


@query("SELECT doc_id, unnest([0, 1]) AS at, unnest(['⟦EMAIL_0123456789⟧', '⟦PERSON_ABCDEFGHJK⟧']) AS token FROM documents")
def R3_scanned_tokens(spark, sf_dir):
    return answers.tokens(table(spark, sf_dir, "documents").select("doc_id", F.expr(ANSWER.replace("|| doc_id", "|| cast(doc_id as string)")).alias("text")))


#: A token in each kind of link, and out of one.
LINKS = (
    ("[x](http://h/{})", True), ("\n[x]: {}", True), ("<{}>", True), ("<a href='{}'>x</a>", True), ("<img src={} >", True), ("https://h.example/{}", True), ("www.h.example/{}", True), ("h.example/{}", True),
    ("url({})", True), ("@import '{}'", True), ("[x](http://h/{}", True), ("&lt;a href={}", True), ("plain {} text", False), ("( {} )", False), ("[{}](http://h/)", False), ("[x]: {}", False), ("a < {} > b", False), ("<a title='>' {}", True), ("mailto:{}", True), ("[x](h(1)/{} y", True), ("[x](h) {}", False),
)


@query("SELECT doc_id, list_value(" + ", ".join(str(x).lower() for _, x in LINKS) + f")[doc_id % {len(LINKS)} + 1] AS linked FROM documents")
def R4_R5_link_contexts(spark, sf_dir):
    said = F.array(*(F.lit(x.replace("{}", "⟦EMAIL_0123456789⟧")) for x, _ in LINKS))
    return table(spark, sf_dir, "documents").select("doc_id", answers.linked(F.concat(F.lit("Answer: "), F.get(said, (F.col("doc_id") % len(LINKS)).cast("int")))).alias("linked"))


_PLACE = "CAST((page_id * 7919) % (length(html) + 1) AS INTEGER)"
_RUN_SQL = r"regexp_extract(ahead, '[^ \t\n\r\f\v]*$') || token || regexp_extract(behind, '^[^ \t\n\r\f\v]*')"


def _within(pattern: str) -> str:
    """Whether the token begins in a match of the pattern."""
    p = oracles.quoted(pattern)
    gaps, whole = f"regexp_split_to_array(said, {p})", f"regexp_extract_all(said, {p})"
    begin = f"list_sum([length(g) for g in {gaps}[1:i]]) + coalesce(list_sum([length(w) for w in {whole}[1:i - 1]]), 0)"
    return f"len([i for i in range(1, len({whole}) + 1) if length(ahead) >= {begin} AND length(ahead) < {begin} + length({whole}[i])]) > 0"


@query(rf"""WITH p AS (SELECT page_id, left(html, {_PLACE}) AS ahead, substr(html, {_PLACE} + 1) AS behind, '⟦EMAIL_0123456789⟧' AS token FROM pages WHERE html IS NOT NULL), t AS (SELECT *, ahead || token || behind AS said, {_RUN_SQL} AS run FROM p)
SELECT page_id, CASE WHEN {_within("""<[A-Za-z/!](?:[^"'>]|"[^"]*(?:"|$)|'[^']*(?:'|$))*>?""")} THEN 'html_tag' WHEN {_within("<[^ \\t\\n\\r\\f\\vA-Za-z/!][^>\\n]*>?")} THEN 'angle_bracket' WHEN {_within(r"(?i)url[(][^)]*[)]?|@import[^\n]*")} THEN 'css_url'
  WHEN contains(run, '://') OR regexp_matches(run, '(?i)(^|[^A-Za-z0-9+.-])(?:{"|".join(links.SCHEMES)}):') THEN 'scheme_url' WHEN regexp_matches(run, {oracles.quoted("(?i)^[(*_\"'<[]*www[.]")}) THEN 'www_url'
  WHEN regexp_matches(run, '[A-Za-z0-9-]\.[A-Za-z]{{2,}}(?:[/?#]|:[0-9])') THEN 'host_path' END AS context FROM t""")
def R4_token_in_pages(spark, sf_dir):
    """A token at some place of each page, and what it stands in."""
    at = F.pmod(F.col("page_id") * 7919, F.length("html") + 1).cast("int")
    said = F.concat(F.substring("html", F.lit(1), at), F.lit("⟦EMAIL_0123456789⟧"), F.substring(F.col("html"), at + 1, F.length("html")))
    pages = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), said.alias("text"))
    return links.token_contexts(pages).select(F.col("doc_id").alias("page_id"), "context")


# Bodies


@query("""SELECT conv_id, '{"model":"fixed","messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || '],"n":1,"stream":false}' AS body FROM conversations GROUP BY conv_id""")
def K1_provider_bodies(spark, sf_dir):
    return bodies.provider_bodies(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg"), "role", "text"), "fixed")


@query("""SELECT doc_id, '{"id":"a-' || doc_id || '","object":"chat.completion","choices":[{"index":0,"message":{"role":"assistant","content":' || to_json(text) || '},"finish_reason":"stop"}]}' AS body FROM documents WHERE text IS NOT NULL""")
def K2_client_bodies(spark, sf_dir):
    body = bodies.client_body(F.concat(F.lit("a-"), F.col("doc_id").cast("string")), F.col("text"), F.lit("stop"))
    return docs_of(spark, sf_dir).where("text is not null").select("doc_id", body.alias("body"))


@query("""SELECT event_id AS id, '{"object":"chat.completion","choices":[{"index":0,"message":{"role":"assistant","content":"This request was not sent. (' || code || ')"},"finish_reason":"stop"}],"decision":"' || CASE WHEN code = 409 THEN 'confirm' WHEN code BETWEEN 400 AND 499 THEN 'blocked' ELSE 'refused' END || '"}' AS body
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 409 WHEN 1 THEN 400 WHEN 2 THEN 102 END AS code FROM events) WHERE code IS NOT NULL""")
def K8_notices(spark, sf_dir):
    k = F.col("event_id") % 4
    return bodies.notices(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(k == 0, 409).when(k == 1, 400).when(k == 2, 102).alias("code")))


@query("""SELECT event_id AS answer_id, CASE event_id % 4 WHEN 1 THEN 601 WHEN 2 THEN 600 WHEN 3 THEN 600 END AS code, CASE WHEN event_id % 4 = 0 THEN 'assistant' END AS role, CASE WHEN event_id % 4 = 0 THEN event_type END AS text,
CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'length' ELSE 'stop' END END AS reason FROM events""")
def S6_provider_answers(spark, sf_dir):
    k, kind = F.col("event_id"), F.col("event_type")
    good = F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":"'), kind, F.lit('"},"finish_reason":"'), F.when(k % 8 == 0, "length").otherwise("Not A Word"), F.lit('"}]}'))
    tool = F.lit('{"choices":[{"message":{"role":"assistant","content":null,"tool_calls":[{"id":"x"}]},"finish_reason":"tool_calls"}]}')
    body = F.when(k % 4 == 0, good).when(k % 4 == 1, tool).when(k % 4 == 2, '{"choices":[]}').otherwise("not json")
    return bodies.scanned_answers(table(spark, sf_dir, "events").select(k.alias("answer_id"), body.alias("body")))


@query("""SELECT doc_id AS part_id, CASE WHEN doc_id % 3 <> 1 THEN 'text/plain' END AS mime, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE '' END AS extension, CASE WHEN doc_id % 3 <> 1 THEN sha256(text) END AS sha, CASE WHEN doc_id % 3 = 1 THEN 302 END AS code FROM documents WHERE text IS NOT NULL""")
def S2_inline_files(spark, sf_dir):
    """Texts as inline files; every third one with a stray character."""
    docs, k = docs_of(spark, sf_dir).where("text is not null"), F.col("doc_id")
    name = F.when(k % 2 == 0, "Notes.TXT").otherwise("dir/notes.txt")
    uri = F.concat(F.lit("data:text/plain;base64,"), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""), F.when(k % 3 == 1, "!").otherwise(""))
    return bodies.inline_files(docs.select(k.alias("part_id"), name.alias("name"), uri.alias("uri"))).select("part_id", "mime", "extension", F.sha2("content", 256).alias("sha"), "code")


# Files, made from tables and read again


@query("""SELECT 'n' || n_nationkey || '.csv' AS path, CAST("at" AS INTEGER) AS "at", text FROM (SELECT n_nationkey, unnest([1, 2, 3, 4]) AS "at", unnest(['name', 'say "hi", you', n_name, 'two' || chr(10) || 'lines']) AS text FROM nation)""")
def S10_csv_cells(spark, sf_dir):
    said = F.concat(F.lit('name,"say ""hi"", you"\r\n'), F.col("n_name"), F.lit(',"two\nlines"\r\n'))
    made = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(said, "UTF-8").alias("content"))
    return files.blocks(made).select("path", "at", "text")


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def office(kind: str, lines: list[str]) -> bytes:
    """A small file of one of the formats with a paragraph, cell or shape for each line, and something hidden."""
    safe = [escape(x) for x in lines]
    if kind == "docx":
        hidden = "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p>"
        return packed({"word/document.xml": '<w:document xmlns:w="w"><w:body>' + "".join(f'<w:p><w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for x in safe) + hidden + "</w:body></w:document>"})
    if kind == "xlsx":
        cells = "".join(f'<row r="{i}"><c t="inlineStr"><is><t>{x}</t></is></c></row>' for i, x in enumerate(safe, 1)) + '<row r="99" hidden="1"><c t="inlineStr"><is><t>hidden</t></is></c></row>'
        return packed({
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="a"/><sheet name="Two" state="hidden" r:id="b"/></sheets></workbook>', "xl/worksheets/s1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s1.xml"/></Relationships>',
        })
    slide = lambda xs, show: f'<p:sld xmlns:p="p" xmlns:a="a"{show}><p:sp>' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in xs) + "</p:sp></p:sld>"
    return packed({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide(safe, ""), "ppt/slides/slide2.xml": slide(["hidden"], ' show="0"')})


def office_files(docs: DataFrame) -> DataFrame:
    """A file for each document: its lines in one of the formats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files.slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = ("docx", "xlsx", "pptx")[key % 3]
                lines = ["".join(c for c in x if c >= " " or c == "\t") for x in (text or "").split("\n")]
                data = office(kind, lines)
                rows.append((f"{key}.{kind}", data))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], ["path", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "path string, content binary")


@query(r"""SELECT doc_id || '.' || list_value('docx', 'xlsx', 'pptx')[doc_id % 3 + 1] AS path, text FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10))) AS text FROM documents WHERE text IS NOT NULL) WHERE trim(text, ' ' || chr(9)) <> ''""")
def S12_S14_S18_S19_office_blocks(spark, sf_dir):
    """Texts as word-processor, spreadsheet and slide files, whose paragraphs, cells and shapes are read again; hidden ones aren't."""
    return files.blocks(office_files(docs_of(spark, sf_dir))).select("path", "text")
