"""SQL for DuckDB that gives what the queries give."""

from __future__ import annotations

from veilworks.functions.structures import IBAN_STRUCTURES
from veilworks.operators.detect import ANCHORS, DASHES, IBAN, IFSC, IFSC_DIGITS, MOST_DIGITS, NEAR, PATTERNS, RUNS, iban_pattern
from veilworks.operators.texts import MARKUP, REFERENCES
from veilworks.operators.policy import ACTIONS, FILLER, MOST_SPANS, TYPES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(name: str, pattern: str, source: str = "documents", around: int = 2) -> str:
    """(doc_id, name, cs, ce, value, before, next) of one pattern whose group 1 ends the match."""
    p = quoted(pattern)
    return f"""
SELECT doc_id, {quoted(name)} AS name, CAST(ce - length(value) AS INTEGER) AS cs, CAST(ce AS INTEGER) AS ce, value, before, next FROM (
  SELECT doc_id, whole[i] AS w, val[i] AS value, left(gaps[i + 1] || CASE WHEN i < len(whole) THEN whole[i + 1] ELSE '' END, {around}) AS next,
    right(CASE WHEN i > 1 THEN whole[i - 1] ELSE '' END || gaps[i], {around}) AS before,
    sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY doc_id ORDER BY i) AS ce
  FROM (SELECT doc_id, whole, val, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {p}, 0) AS whole, regexp_extract_all(text, {p}, 1) AS val, regexp_split_to_array(text, {p}) AS gaps FROM {source} WHERE text IS NOT NULL)))
WHERE coalesce(value, '') <> ''"""


_MARK = quoted(MARKUP)
_NAMED = "CASE m " + " ".join(f"WHEN '&{n};' THEN {quoted(c)}" for n, c in REFERENCES) + " END"
_NUMBER = "CASE WHEN lower(m)[3] = 'x' THEN CAST('0x' || m[4:-2] AS BIGINT) ELSE CAST(m[3:-2] AS BIGINT) END"
_IN_PLACE = rf"""CASE WHEN m[1] = '<' THEN CASE WHEN regexp_matches(m, '(?i)^<t[dh][> /\t\n\r]') THEN '| ' WHEN regexp_matches(m, '(?i)^</tr[> /\t\n\r]') THEN ' |' ELSE '' END
  || CASE WHEN regexp_matches(m, '(?i)^<(?:br|/p|p|/div|/tr|/li|/h|h)') THEN chr(10) ELSE '' END || CASE WHEN regexp_matches(m, '(?i)^</t[dh]') THEN chr(9) ELSE '' END
  WHEN m[2] = '#' THEN CASE WHEN {_NUMBER} BETWEEN 1 AND 1114111 AND {_NUMBER} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({_NUMBER} AS INTEGER)) ELSE m END ELSE {_NAMED} END"""
HTML_LINES = f"""WITH t AS (SELECT page_id, regexp_split_to_array(html, {_MARK}) AS gaps, [{_IN_PLACE} for m in regexp_extract_all(html, {_MARK}, 0)] AS marks FROM pages WHERE html IS NOT NULL),
x AS (SELECT page_id, [y for y in [trim(z, ' ' || chr(9)) for z in string_split(array_to_string([replace(gaps[i], chr(13), chr(10)) || coalesce(marks[i], '') for i in range(1, len(gaps) + 1)], ''), chr(10))] if y <> ''] AS x FROM t)
SELECT page_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS line, unnest(x) AS text FROM x"""

OCTETS = "len([o for o in string_split(value, '.') if CAST(o AS INTEGER) > 255 OR CAST(CAST(o AS INTEGER) AS VARCHAR) <> o]) = 0"
MAILBOX = r"NOT contains(value, '.@') AND length(split_part(value, '@', -1)) <= 255 AND NOT regexp_matches(split_part(value, '@', -1), '^-|-$|-\.|\.-')"
_QUAD = r"regexp_matches(value, '(?:^|:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$') AND len([o for o in string_split(regexp_extract(value, '[0-9.]+$'), '.') if TRY_CAST(o AS INTEGER) > 255 OR CAST(TRY_CAST(o AS INTEGER) AS VARCHAR) <> o]) = 0"
#: With a trailing dotted quad written as two groups, every group is hexadecimal, and there are eight, or fewer around one double colon.
IPV6 = rf"""(SELECT NOT contains(v, '.') AND regexp_matches(v, '^(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}})*)?(?:::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}})*)?)?$')
  AND CASE WHEN contains(v, '::') THEN len([g for g in string_split(v, ':') if g <> '']) <= 7 ELSE len(string_split(v, ':')) = 8 END
  FROM (SELECT CASE WHEN {_QUAD} THEN regexp_replace(value, '[0-9.]+$', '0:0') ELSE value END AS v))"""
VALID = {"email": MAILBOX, "ipv4": OCTETS, "ipv6": IPV6}


def patterns(source: str = "documents") -> str:
    """(doc_id, cs, ce, type, detector, value) of all patterns."""
    parts = []
    for p in PATTERNS:
        also = (f" AND NOT regexp_matches(next, {quoted(f'^(?:{p.stop})')})" if p.stop else "") + (f" AND {VALID[p.name]}" if p.name in VALID else "")
        parts.append(f"SELECT doc_id, cs, ce, {quoted(p.type)} AS type, {quoted(p.name)} AS detector, value FROM ({matches(p.name, f'{p.lead}({p.body})', source)}) WHERE true{also}")
    return "\nUNION ALL\n".join(parts)


def windows(source: str = "documents", run: str = RUNS, around: int = 2) -> str:
    """(doc_id, cs, ce, digits, shape, run, run_at, before, next) of all windows."""
    return f"""
SELECT doc_id, CAST(cs + list_sum([length(x) for x in gaps[1:a + 1]]) + coalesce(list_sum([length(x) for x in groups[1:a]]), 0) AS INTEGER) AS cs,
  CAST(cs + list_sum([length(x) for x in gaps[1:b + 1]]) + list_sum([length(x) for x in groups[1:b + 1]]) AS INTEGER) AS ce, array_to_string(groups[a + 1:b + 1], '') AS digits,
  array_to_string([CASE WHEN k = a THEN '' WHEN regexp_matches(gaps[k + 1], '^[{DASHES}]$') THEN '-' ELSE '~' END || length(groups[k + 1]) for k in range(a, b + 1)], '') AS shape, run, cs AS run_at, before, next
FROM (SELECT *, unnest(range(a, least(most, a + {MOST_DIGITS}))) AS b FROM (
  SELECT *, unnest(range(least_, most)) AS a FROM (SELECT *, CAST(regexp_matches(before, '[A-Za-z0-9]$') AS INTEGER) AS least_, len(groups) - CAST(regexp_matches(next, '^[A-Za-z0-9]') AS INTEGER) AS most FROM (
    SELECT doc_id, cs, before, next, value AS run, regexp_extract_all(value, '[0-9]+') AS groups, regexp_split_to_array(value, '[0-9]+') AS gaps FROM ({matches('run', run, source, around)})))))
WHERE length(array_to_string(groups[a + 1:b + 1], '')) <= {MOST_DIGITS}"""


def at(i: int) -> str:
    return f"CAST(substr(digits, {i}, 1) AS INTEGER)"


def weighted(weights: list[int]) -> str:
    return " + ".join(f"{at(i)} * {w}" for i, w in enumerate(weights, 1))


LUHN = "list_sum([CASE WHEN (length(digits) - i) % 2 = 1 THEN CASE WHEN CAST(substr(digits, i, 1) AS INTEGER) > 4 THEN CAST(substr(digits, i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(digits, i, 1) AS INTEGER) * 2 END ELSE CAST(substr(digits, i, 1) AS INTEGER) END for i in range(1, length(digits) + 1)]) % 10 = 0"
RULES = {
    "phone": r"regexp_matches(CASE WHEN regexp_matches(digits, '^82[0-9]{8,}$') THEN '0' || substr(digits, 3) ELSE digits END, '^(?:010[2-9][0-9]{7}|01[16789][0-9]{7,8}|070[0-9]{8}|050[0-9]{8,9}|02[0-9]{7,8}|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4])[0-9]{7,8})$')",
    "resident": "CASE WHEN regexp_matches(digits, '^[0-9]{6}[1-4][0-9]{6}$') THEN try_strptime(CASE WHEN substr(digits, 7, 1) IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || substr(digits, 1, 6), '%Y%m%d') IS NOT NULL ELSE false END",
    "alien": "CASE WHEN regexp_matches(digits, '^[0-9]{6}[5-8][0-9]{6}$') THEN try_strptime(CASE WHEN substr(digits, 7, 1) IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || substr(digits, 1, 6), '%Y%m%d') IS NOT NULL ELSE false END",
    "business": f"CASE WHEN regexp_matches(digits, '^[0-9]{{10}}$') THEN (10 - ({weighted([1, 3, 7, 1, 3, 7, 1, 3, 5])} + ({at(9)} * 5) // 10) % 10) % 10 = {at(10)} ELSE false END",
    "card": f"CASE WHEN regexp_matches(digits, '^[1-9][0-9]{{12,18}}$') THEN {LUHN} ELSE false END",
    "clabe": "CASE WHEN regexp_matches(digits, '^[0-9]{18}$') THEN (10 - (" + " + ".join(f"({at(i + 1)} * {(3, 7, 1)[i % 3]}) % 10" for i in range(17)) + f") % 10) % 10 = {at(18)} ELSE false END",
    "routing": f"CASE WHEN regexp_matches(digits, '^[0-9]{{9}}$') THEN ({weighted([3, 7, 1, 3, 7, 1, 3, 7, 1])}) % 10 = 0 ELSE false END",
}


def numbers(source: str = "documents", found: str = "", keep: str = "") -> str:
    return f"""
SELECT doc_id, cs, ce, h[1] AS type, h[2] AS detector, value{keep} FROM (
  SELECT doc_id, cs, ce{keep}, digits AS value, unnest([x for x in [
    CASE WHEN {RULES['phone']} THEN ['KOREAN_PHONE', 'Pattern'] END, CASE WHEN {RULES['resident']} THEN ['KOREAN_RRN', 'Pattern'] END,
    CASE WHEN {RULES['alien']} THEN ['KOREAN_ALIEN_REGISTRATION_NO', 'Pattern'] END, CASE WHEN {RULES['business']} THEN ['KOREAN_BUSINESS_NO', 'Checksum'] END,
    CASE WHEN {RULES['card']} THEN ['CARD_NUMBER', 'Checksum'] END, CASE WHEN {RULES['clabe']} THEN ['BANK_ACCOUNT', 'Checksum'] END,
    CASE WHEN regexp_matches(digits, '^62[0-9]{{14,17}}$') OR shape IN ('3-7', '5-8') THEN ['BANK_ACCOUNT', 'Pattern'] END,
    CASE WHEN shape = '2-2-6-2' AND substr(digits, 1, 2) BETWEEN '11' AND '28' THEN ['KOREAN_DRIVER_LICENSE_NO', 'Pattern'] END] if x IS NOT NULL]) AS h
  FROM ({found or windows(source)}))"""


def anchored(source: str = "documents") -> str:
    kind = f"CASE WHEN {RULES['routing']} AND shape = '9' THEN 'routing' ELSE shape END"
    limits = ", ".join(f"({quoted(k)}, {lo}, {hi})" for k, lo, hi in ANCHORS)
    return f"""
SELECT DISTINCT doc_id, unnest([cs, account.cs]) AS cs, unnest([ce, account.ce]) AS ce, 'BANK_ACCOUNT' AS type, unnest([detector, 'Pattern']) AS detector, unnest([value, account.digits]) AS value FROM (
  SELECT a.doc_id, a.cs, a.ce, a.value, a.detector, min({{'cs': w.cs, 'ce': w.ce, 'digits': w.digits}}) AS account FROM (
    SELECT doc_id, cs, ce, digits AS value, lo, hi, CASE WHEN k = 'routing' THEN 'Checksum' ELSE 'Pattern' END AS detector FROM (SELECT *, {kind} AS kind FROM ({windows(source)})) x JOIN (VALUES {limits}) l(k, lo, hi) ON kind = k
    UNION ALL SELECT doc_id, cs, ce, value, {IFSC_DIGITS[0]}, {IFSC_DIGITS[1]}, 'Pattern' FROM ({matches('ifsc', IFSC, source)}) WHERE NOT regexp_matches(next, '^[A-Za-z0-9]')) a
  JOIN ({windows(source)}) w ON a.doc_id = w.doc_id AND (w.ce <= a.cs OR w.cs >= a.ce) AND w.cs >= a.cs - {NEAR} AND w.ce <= a.ce + {NEAR} AND length(w.digits) BETWEEN lo AND hi
  GROUP BY a.doc_id, a.cs, a.ce, a.value, a.detector, lo)"""


def ibans(source: str = "documents") -> str:
    known = ", ".join(f"('{c}', {quoted(iban_pattern(c, b))})" for c, _, b in IBAN_STRUCTURES)
    return f"""
SELECT doc_id, cs, CAST(cs + length(own) AS INTEGER) AS ce, 'BANK_ACCOUNT' AS type, 'Pattern' AS detector, replace(own, ' ', '') AS value FROM (
  SELECT doc_id, cs, value, next, regexp_extract(value, pattern) AS own FROM ({matches('iban', IBAN, source)}) JOIN (VALUES {known}) k(country, pattern) ON substr(value, 1, 2) = country)
WHERE own <> '' AND NOT regexp_matches(substr(value || next, length(own) + 1, 1), '^[A-Za-z0-9]')"""


TYPE_ROWS = ", ".join(f"({quoted(t)}, {i}, {quoted(a)}, {ACTIONS.index(a)}, {r})" for i, (t, a, r) in enumerate(TYPES))


def spans_of(source: str = "documents") -> str:
    return f"""
types(type, ordinal, action, strength, label_rank) AS (VALUES {TYPE_ROWS}),
spans AS (SELECT DISTINCT doc_id, cs, ce, type, detector, value FROM ({patterns(source)}\nUNION ALL\n{numbers(source)}\nUNION ALL\n{anchored(source)}\nUNION ALL\n{ibans(source)}))"""


ACTED = """acted AS (SELECT s.*, ordinal, action, strength, label_rank FROM spans s JOIN types t ON s.type = t.type),
begun AS (SELECT *, CASE WHEN coalesce(max(ce) OVER (PARTITION BY doc_id ORDER BY cs, ce, ordinal, detector ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= cs, true) THEN 1 ELSE 0 END AS starts FROM acted),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY cs, ce, ordinal, detector ROWS UNBOUNDED PRECEDING) AS island FROM begun),
merged AS (
  SELECT doc_id, min(cs) AS cs, max(ce) AS ce, arg_max(action, strength * 1000 - label_rank) AS action, arg_max(type, strength * 1000 - label_rank) AS label,
    array_to_string(list_sort(list_distinct(list(type))), ',') AS types
  FROM islands GROUP BY doc_id, island)"""


SPANS, WINDOWS, NUMBERS = f"{spans_of()},\n{ACTED}", windows(), numbers()
FIND_ALL = f"WITH {SPANS} SELECT doc_id, cs, ce, type, detector, value FROM spans"
POLICY = f"""WITH {SPANS}, per AS (
  SELECT doc_id, count(*) AS n_spans, list_sort(list_distinct(list(type) FILTER (WHERE action = 'block'))) AS blocked FROM acted GROUP BY doc_id),
coded AS (SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, blocked, CASE WHEN n_spans > {MOST_SPANS} THEN 203 WHEN len(blocked) > 0 THEN 400 END AS code FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id)
SELECT doc_id, n_spans, CAST(code AS INTEGER) AS code, CASE WHEN code = 400 THEN array_to_string(blocked, ',') ELSE '' END AS blocked_types FROM coded"""
MERGE = f"WITH {SPANS} SELECT * FROM merged"
COUNTS = f"WITH {SPANS} SELECT doc_id, type, count(*) AS n FROM spans GROUP BY ALL"
RESIDUAL = f"""WITH {SPANS} SELECT doc_id, cs, ce, type, detector, value FROM spans s
WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.action = 'tokenize' AND m.doc_id = s.doc_id AND m.cs <= s.cs AND s.ce <= m.ce)"""


def keyed(secret: bytes, message: str) -> str:
    key = secret.ljust(64, b"\0")
    blob = lambda pad: "'" + "".join(f"\\x{k ^ pad:02X}" for k in key) + "'::BLOB"
    return f"sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({message}))))"


def tokens(secret: bytes, draws: int = 8) -> str:
    """(doc_id, label, value, token): the first draw that holds no four characters of the value in a row."""
    digest = keyed(secret, "CAST(doc_id AS VARCHAR) || chr(0) || label || chr(0) || value || chr(0) || CAST(k AS VARCHAR)")
    marks = "array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(('0x' || substr(digest, 2 * i + 1, 2)) AS INTEGER) % 32 + 1, 1) for i in range(0, 10)], '')"
    leaks = "len([i for i in range(1, greatest(length(value) - 3, 1) + 1) if contains(marks, upper(substr(value, i, 4)))]) > 0"
    return f"""WITH {SPANS}, valued AS (
  SELECT DISTINCT m.doc_id, label, substr(text, m.cs + 1, m.ce - m.cs) AS value FROM merged m JOIN documents d ON m.doc_id = d.doc_id WHERE m.action = 'tokenize'),
digested AS (SELECT *, {digest} AS digest FROM (SELECT *, unnest(range(0, {draws})) AS k FROM valued)),
drawn AS (SELECT doc_id, label, value, k, {marks} AS marks FROM digested)
SELECT doc_id, label, value, '⟦' || label || '_' || arg_min(marks, k) || '⟧' AS token FROM drawn WHERE NOT ({leaks}) GROUP BY doc_id, label, value"""


def rewritten(said: str, source: str = "documents") -> str:
    return f"""WITH {spans_of(source)},
{ACTED}, spots AS (
  SELECT m.doc_id, m.cs, m.ce, {said} AS said, lag(m.ce, 1, 0) OVER w AS since, row_number() OVER w AS i FROM merged m WHERE m.action = 'tokenize' WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.cs)),
heads AS (SELECT s.doc_id, string_agg(substr(text, since + 1, cs - since) || said, '' ORDER BY i) AS head, max(ce) AS upto, count(*) AS n FROM spots s JOIN {source} d ON s.doc_id = d.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(head, '') || substr(text, coalesce(upto, 0) + 1) END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_replaced
FROM {source} d LEFT JOIN heads h ON d.doc_id = h.doc_id"""


def sentences(marks: str, gap: str, newline: str, source: str = "documents") -> str:
    marked = f"regexp_replace(text, '([{marks}])({gap}|$)', '\\1' || chr(1) || '\\2', 'g')"
    marked = f"regexp_replace({marked}, {newline}, 'g')"
    return f"""SELECT doc_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS at, unnest(x) AS text FROM (
  SELECT doc_id, [y for y in [regexp_replace(z, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') for z in string_split({marked}, chr(1))] if y <> ''] AS x FROM {source} WHERE text IS NOT NULL)"""


RULE_SENTENCES = sentences(".?!。…", "[ \\t\\r\\n]", "'\\n', chr(10) || chr(1)")
LINES = r"""SELECT doc_id, line, text FROM (SELECT doc_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS line, regexp_replace(unnest(x), '\r$', '') AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) WHERE trim(text) <> ''"""
_FILLER = FILLER
