"""Queries of the whole scan, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.operators import evidence, names, policy, scan, surprise, texts
from veilworks.plans import oracles
from veilworks.plans.evidence import trim_sql
from veilworks.plans.registry import docs_of, query

#: One text of each kind that the scan finds, beside what it is to find; ours, in the order of the detectors. Each document gets the one of its number after its own first line.
KINDS = (
    ("call 010-2345-6789", "KOREAN_PHONE"), ("id 900101-1234567", "KOREAN_RRN"), ("id 010203-7234567", "KOREAN_ALIEN_REGISTRATION_NO"), ("firm 220-81-83676", "KOREAN_BUSINESS_NO"), ("card 4111 1111 1111 1111", "CARD_NUMBER"),
    ("licence 11-22-333333-44", "KOREAN_DRIVER_LICENSE_NO"), ("면허 112233333344", "KOREAN_DRIVER_LICENSE_NO"), ("면허 서울 12-345678-90", "KOREAN_DRIVER_LICENSE_NO"), ("pass M12345678", "KOREAN_PASSPORT_NO"), ("card 4111 1111\n1111 1111 here", "CARD_NUMBER"),
    ("mail ann.b@mail.example.org", "EMAIL"), ("host 10.0.0.255", "IP_ADDRESS"), ("host 2001:db8::8a2e:370:7334", "IP_ADDRESS"), ("pay 123-45-6789012 now", "BANK_ACCOUNT"), ("account no 987654321 ok", "BANK_ACCOUNT"),
    ("routing 021000021 account 12345678", "BANK_ACCOUNT"), ("clabe 032180000118359719", "BANK_ACCOUNT"), ("sort 12-34-56 acct 12345678", "BANK_ACCOUNT"), ("iban DE89 3704 0044 0532 0130 00 it", "BANK_ACCOUNT"), ("IFSC HDFC0001234 a/c 123456789012", "BANK_ACCOUNT"),
    ("key sk-abcdefghij0123456789XYZ", "API_KEY"), ("Bearer abcdefghijklmnopqrstuvwx", "API_KEY"), ("eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "API_KEY"), ("-----BEGIN RSA PRIVATE KEY-----abc", "PRIVATE_KEY"), ("password: hunter22", "CREDENTIAL"),
    ("see http://joe:pass99@h.example/", "CREDENTIAL"), ("our pro ject zebra plan", "INTERNAL_TERM"), ("NorthwindBank called", "ORGANIZATION"), ("case no: AB-12345/7", "INSTITUTION_ID"), ("ref QX-4821-7", "INSTITUTION_ID"),
    ("strictly confidential paper", "CONFIDENTIAL_MARKER"), ("The bid is secret now. The tender opens late.", "CONFIDENTIAL_MATTER"), ("ann@mail.example.org has diabetes.", "SENSITIVE_PERSONAL_INFO"), ("id 900101\\text{-}1234567", "KOREAN_RRN"), ("nothing here", "NONE"), ("diabetes is common", "NONE"),
)
#: What is to become of the texts whose spans are replaced.
REDACTED = {
    "call 010-2345-6789": "call {}", "firm 220-81-83676": "firm {}", "mail ann.b@mail.example.org": "mail {}", "host 10.0.0.255": "host {}", "host 2001:db8::8a2e:370:7334": "host {}",
    "our pro ject zebra plan": "our {} plan", "NorthwindBank called": "{} called", "case no: AB-12345/7": "case no: {}", "ref QX-4821-7": "ref {}",
}
_HEAD = "'Note ' || translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij') || ':' || chr(10) || "
_PLACES = {k: a for k, a, _ in policy.TYPES}


def rules(spark) -> scan.Rules:
    formats = spark.createDataFrame([("north", 12, "3-2-7", 4, ["45"])], "bank string, digits int, shape string, subject_at int, subjects array<string>")
    return scan.Rules(
        terms=["project zebra"], markers=["strictly confidential"], formats=F.broadcast(formats), account_words=["account no"], labels=["case no"], masks=["QX-####-#"], tails=["Bank"], generic=["savings"],
        matter_markers=["secret"], matter_subjects=["tender", "bid"], categories={"Health": ["diabetes"]},
    )


def of_each_kind(spark, sf_dir) -> DataFrame:
    """Each document's number and one of KINDS; the table's own words would add spans that the SQL would have to know."""
    said = F.get(F.array(*(F.lit(t) for t, _ in KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))
    return docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("Note "), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"), F.lit(":\n"), said).alias("text"))


@query("SELECT doc_id, list_value(" + ", ".join(oracles.quoted(k) for _, k in KINDS) + f")[doc_id % {len(KINDS)} + 1] AS wanted, true AS found FROM documents")
def D0_scan_of_each_kind(spark, sf_dir):
    """Whether the scan finds in each document the kind that was put there, and nothing where nothing was."""
    docs = of_each_kind(spark, sf_dir)
    want = F.get(F.array(*(F.lit(k) for _, k in KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))
    kinds = scan.scan(docs, rules(spark)).groupBy("doc_id").agg(F.collect_set("type").alias("types"))
    fine = F.when(F.col("wanted") == "NONE", F.coalesce(F.size("types"), F.lit(0)) <= 0).otherwise(F.array_contains("types", F.col("wanted")))
    return docs.select("doc_id", want.alias("wanted")).join(kinds, "doc_id", "left").select("doc_id", "wanted", F.coalesce(fine, F.lit(False)).alias("found"))


@query(
    "SELECT doc_id, CAST(CASE WHEN list_value(" + ", ".join(str(_PLACES.get(k) == "block").lower() for _, k in KINDS) + f")[doc_id % {len(KINDS)} + 1] THEN 400 END AS INTEGER) AS code, {_HEAD}list_value("
    + ", ".join(oracles.quoted(REDACTED.get(t, t).replace("{}", "⟦REDACTED⟧")).replace("\n", "' || chr(10) || '") for t, _ in KINDS) + f")[doc_id % {len(KINDS)} + 1] AS text FROM documents"
)
def P1_P6_scanned_decisions(spark, sf_dir):
    """Decision and rewritten text of each kind: every detector's spans reach the policy."""
    docs = texts.identified(of_each_kind(spark, sf_dir))
    spans = scan.scan(docs, rules(spark))
    code = policy.check(docs, spans).select("doc_id", "code")
    return texts.named(policy.rewrite(docs, policy.merge(spans)).join(code, "doc_id")).select("doc_id", "code", "text")


#: Values that look random beside words that announce one, and near misses. Our own values.
RANDOM = (
    "password zX9#qT4w$Lp2", "login is qz7KxWv93JpB today.", "password remember123", "token thereafter1", "account 12345678", "key information2024", "secret: deadbeef01234567", "user anderson42", "pin Kj8fQx2Lw!", "key 5f4dcc3b5aa765d61d8327deb882cf99",
    "nothing Kj8fQx2Lw9 here", "credential, as said before: bX4kQ9zJ", "password\nbX4kQ9zJ", "the token (aQ1-zX8-kW3).", "key a1",
)
_SAID = f"(SELECT doc_id, coalesce(text, '') || chr(10) || list_value({', '.join(oracles.quoted(x) for x in RANDOM)})[doc_id % {len(RANDOM)} + 1] AS text FROM documents)".replace("\n", "' || chr(10) || '")
_CODE = "regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0]', ' ', 'g')"
_LEAD = "|".join(sorted(surprise.WORDS, key=lambda w: (-len(w), w)))
_SIGNS = surprise._SIGNS


@query(rf"""WITH c AS (SELECT regexp_extract_all(' ' || {_CODE.format("coalesce(text, '')")} || ' ', '(?s).') AS l FROM documents), p AS (SELECT unnest([l[i] || l[i + 1] for i in range(1, len(l))]) AS ab FROM c), n AS (SELECT ab, count(*) AS n FROM p GROUP BY ab),
k AS (SELECT unnest(regexp_extract_all('{surprise.ALPHABET}', '.')) AS c), g AS (SELECT a.c || b.c AS ab, a.c AS a, coalesce(n, 0) + 1 AS n FROM k a CROSS JOIN k b LEFT JOIN n ON n.ab = a.c || b.c),
bits AS (SELECT ab, round(-log2(n / sum(n) OVER (PARTITION BY a)), 9) AS bits FROM g),
m AS (SELECT doc_id, cs, regexp_replace(value, '[.!-]+$', '') AS value FROM ({oracles.matches("value", f"(?:^|[^A-Za-z0-9{_SIGNS}])([A-Za-z{_SIGNS}]*[0-9][A-Za-z0-9{_SIGNS}]*)", _SAID, surprise.REACH + max(map(len, surprise.WORDS)) + 2)})
  WHERE regexp_matches(before, '(?i)(?:{_LEAD})(?:[^A-Za-z0-9\n][^\n]{{0,{surprise.REACH}}})?$')),
f AS (SELECT *, row_number() OVER () AS r FROM m WHERE length(value) BETWEEN {surprise.LEAST} AND {surprise.MOST} AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '{surprise.DIGEST}')
  AND length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[a-z]+', 's', 'g'), '[A-Z]+', 'L', 'g'), '[0-9]+', '0', 'g'), '[^sL0]+', '-', 'g')) > {surprise.CHANGES}),
x AS (SELECT r, unnest([substr({_CODE.format("value")}, i, 2) for i in range(1, length(value))]) AS ab FROM f), s AS (SELECT r, round(avg(bits), 6) AS bits FROM x JOIN bits USING (ab) GROUP BY r)
SELECT doc_id, cs, CAST(cs + length(value) AS INTEGER) AS ce, 'CREDENTIAL' AS type, 'random' AS detector, value, bits FROM f JOIN s USING (r) WHERE bits >= {surprise.BITS}""")
def D22_random_values(spark, sf_dir):
    """Planted values that look random, by pairs counted in the documents."""
    docs = docs_of(spark, sf_dir)
    tail = F.get(F.array(*map(F.lit, RANDOM)), (F.col("doc_id") % len(RANDOM)).cast("int"))
    return surprise.find_random(docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail).alias("text")), surprise.pairs(docs))


# Names

#: Texts with the part that a rough detector took for a name, and of what type. Our own values.
ROUGH = (
    ("담당자 김민수님께 보냄", "민수", "PERSON"), ("담당자 김민수님이다.", "김민수님이", "PERSON"), ("승인자는 편단우다", "편단", "PERSON"), ("진지우9팀장에게", "지우9", "PERSON"), ("신태호 주무관은 옴", "신태호 주무관", "PERSON"),
    ("주식회사 다온제약을 봄", "주식회사 다온", "ORGANIZATION"), ("(주)가온이다", "주)가온", "ORGANIZATION"), ("(서울)누리은행 홍보팀에서", ")누리은행 홍보", "ORGANIZATION"), ("인사팀은 쉼", "인사팀", "ORGANIZATION"), ("온누리은행이 말함", "온누리은행", "PERSON"),
    ("see Annda", "Ann", "PERSON"), ("** !!", "**", "PERSON"), ("\"Kim Lee\" said", "\"Kim Le", "PERSON"), ("이수다", "이수", "PERSON"),
)
ENDINGS = names.Endings(
    particles=[("은", "final"), ("는", "open"), ("을", "final"), ("이", "final"), ("께", ""), ("에게", ""), ("에서", "")], copulas=["입니다", "이다", "였다"], honorifics=["님", "씨"], titles=["팀장", "주무관"], departments=["팀", "과"], generic=["인사", "총무"], forms=["주식회사"], short_forms=["주"], tails=["은행"],
)


def _off(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, {oracles.quoted(pattern)}, '\\1')"


def _rounds_sql() -> str:
    """A table for each step of each round."""
    out, before = [], "w0"
    for k in range(names.ROUNDS):
        steps = (
            f"SELECT * REPLACE ({trim_sql('w', 1, ENDINGS.particles)} AS w) FROM {before}",
            f"SELECT * REPLACE ({_off('w', names.tail_off(ENDINGS.copulas))} AS w) FROM a{k}",
            f"SELECT * REPLACE (CASE WHEN ends_with(w, '{names.SHORT_COPULA}') AND length(w) > {names.LEAST} AND (left(w, -1)[-1] BETWEEN '가' AND '힣' AND (ascii(left(w, -1)[-1]) - 44032) % 28 = 0 OR regexp_matches(left(w, -1), '[A-Za-z]$')) THEN left(w, -1) ELSE w END AS w) FROM b{k}",
            f"SELECT * REPLACE (CASE WHEN person THEN {_off('w', names.last_word_off(ENDINGS.titles, []))} ELSE {_off('w', names.last_word_off(ENDINGS.titles, ENDINGS.departments))} END AS w) FROM c{k}",
            f"SELECT * REPLACE (CASE WHEN person THEN {_off(_off(_off('w', names.tail_off(ENDINGS.honorifics)), names.tail_off(ENDINGS.titles)), f"^([\\s\\S]{{{names.LEAST},}}?)[0-9]+$")} ELSE w END AS w) FROM d{k}",
        )
        out += [f"{n}{k} AS ({s})" for n, s in zip("abcde", steps)]
        before = f"e{k}"
    return ",\n".join(out)


_W = evidence.WORD


@query(f"""WITH p AS (SELECT doc_id, list_value({", ".join(f"{{'t': {oracles.quoted(t)}, 's': {oracles.quoted(x)}, 'k': '{k}'}}" for t, x, k in ROUGH)})[doc_id % {len(ROUGH)} + 1] AS p FROM documents),
s AS (SELECT doc_id, p.t AS t, p.k AS type, p.s AS said, p.k = 'PERSON' AS person, strpos(p.t, p.s) - 1 AS cs FROM p WHERE strpos(p.t, p.s) > 0 AND regexp_matches(p.s, '[{_W}]')),
g AS (SELECT *, length(regexp_extract(said, '^[^{_W}]*')) AS lead, length(regexp_extract(said, '[^{_W}]*$')) AS trail, regexp_extract(left(t, cs), '[{_W}]*$') AS l, regexp_extract(substr(t, cs + length(said) + 1), '^[{_W}]*') AS r FROM s),
h AS (SELECT *, CASE WHEN lead > 0 THEN '' ELSE l END || substr(said, lead + 1, length(said) - lead - trail) || CASE WHEN trail > 0 THEN '' ELSE r END AS word, CASE WHEN lead > 0 THEN cs + lead ELSE cs - length(l) END AS place FROM g),
w0 AS (SELECT doc_id, type, person, place + length(word) - length(w) AS place, w FROM (SELECT *, CASE WHEN person THEN word ELSE regexp_replace(word, '^(?:주식회사[^{_W}]*|주[)])([{_W}].+)$', '\\1') END AS w FROM h)),
{_rounds_sql()}
SELECT DISTINCT doc_id, CAST(place AS INTEGER) AS cs, CAST(place + length(w) AS INTEGER) AS ce, CASE WHEN person AND regexp_matches(w, '^.{{2,}}은행$') THEN 'ORGANIZATION' ELSE type END AS type, 'Rough' AS detector, w AS value FROM e{names.ROUNDS - 1}
WHERE person OR w NOT IN ('인사팀', '인사과', '총무팀', '총무과')""")
def D32_repaired_names(spark, sf_dir):
    """Names cut badly, put right."""
    pick = lambda k: F.get(F.array(*(F.lit(r[k]) for r in ROUGH)), (F.col("doc_id") % len(ROUGH)).cast("int"))
    rows = docs_of(spark, sf_dir).select("doc_id", pick(0).alias("text"), pick(1).alias("said"), pick(2).alias("type")).where(F.contains("text", F.col("said")))
    cs = F.instr("text", F.col("said")) - 1
    spans = rows.select("doc_id", cs.alias("cs"), (cs + F.length("said")).alias("ce"), "type", F.lit("Rough").alias("detector"))
    return names.repaired(rows.select("doc_id", "text"), spans, ENDINGS)
