"""Divergence, repeated passages and ranked search against SQL, brute force and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilworks.llm import divergence, html, registry, search, suffixes

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "one", "é ñandú 日本 Straße", "A" * 300, "word " * 3000, "x\x00y 12-34", "ÀB c1d2"]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_prefix_free_parsing", "op13_threshold_search"])
def test_matches_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE TABLE want AS {registry.oracle_sql()[name]}")
    got = f"(SELECT {', '.join(df.columns)} FROM '{tmp_path}/out/*.parquet')"
    want = f"(SELECT {', '.join(df.columns)} FROM want)"
    for a, b in ((want, got), (got, want)):
        assert duck.execute(f"SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b})").fetchone() == (0,)
    assert duck.execute("SELECT count(*) FROM want").fetchone()[0] > 0


# 11


def divergence_by_hand(rows, least):
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))) for lang, source, text in rows]
    out = []
    for lang in {w[0] for w in words}:
        docs = Counter(t for la, _, c in words if la == lang for t in c)
        kept = sorted((t for t, n in docs.items() if n >= least), key=str.encode)
        groups = {s: Counter() for la, s, _ in words if la == lang}
        for la, s, c in words:
            if la == lang:
                groups[s].update({t: n for t, n in c.items() if t in set(kept)})
        total = sum(groups.values(), Counter())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        own, q = {s: price(c) for s, c in groups.items()}, price(total)
        for s in groups:
            pairs = [(sum(apart(own[s][t], own[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(apart(own[s][t], q[t]), t) for t in kept if groups[s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence_by_hand(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None]), " ".join(draw.choices(["the", "The", "of", "é", "cat", "dog", "x1y", "zu"], [9, 3, 5, 1, 2, 2, 1, 1], k=draw.randint(0, 30)))) for _ in range(120)]
    rows += [("en", "a", t) for t in ODD] + [("fr", "only", "rare words"), ("fr", "other", None), ("it", None, ""), ("en", "b", "same text")] + [("en", "b", "same text")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit(1), "term": F.lit("t"), "item": F.lit("i"), "p": F.lit(0)})
    for least in (3, 10, 10**6):
        assert sorted(map(tuple, divergence.audit(docs, least).collect())) == divergence_by_hand(rows, least)
    assert divergence.audit(docs.where("false")).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ab é, " * 500 + "z" * 100 + " end"
    whole = [t for piece in divergence.terms(text) for t in piece]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for piece in divergence.terms(text) for t in piece] == whole == re.findall(rb"[a-z\xc3\xa9]+", text.lower().encode())


def test_prices_beyond_long(spark):
    n = 10**13
    got = spark.range(1).select(divergence.price(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (3 * n + 14)


# 12


def kept_by_hand(rows, depth=50):
    """(id, bytes, removed, spans, kept) by all passages of smaller ids."""
    out = []
    for i, text in rows:
        data = (text or "").encode()
        smaller = {b[k : k + depth] for j, t in rows if (j is not None and (i is None or j < i)) for b in [(t or "").encode()] for k in range(len(b) - depth + 1)}
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - depth + 1):
            if data[k : k + depth] in smaller:
                gone[k : k + depth] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""))
    return sorted(out, key=str)


def passages(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdé ", k=draw.randint(1, 9)))
    shared = [" ".join(word() for _ in range(draw.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [draw.choice(shared)[draw.randint(0, 9) :] if draw.random() < 0.5 else " ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 6))]
        rows.append((draw.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(100, "same line " * 30), (101, "same line " * 40), (102, "ab" * 200), (103, "ba" * 90), (104, rows[3][1]), (105, rows[3][1]), (105, rows[3][1]), (106, None), (107, ""), (108, "x" * 49), (109, "x" * 50), (110, "x" * 51), (None, "x" * 60), (None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_by_hand(spark, seed):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("d"), "tag": F.lit("t"), "bucket": F.lit(0), "phrases": F.lit(1), "a": F.lit(2)})
    got = suffixes.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == kept_by_hand(rows)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() and sum(s.end - s["at"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert suffixes.remove_repeats(docs.where("false")).count() == 0


def test_pieces_keep_every_passage(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 200)
    text = "".join(random.Random(5).choices("abc é", k=3000))
    data, found = text.encode(), Counter()
    for pieces, offsets in suffixes.pieces_of([None, text, "short", text]):
        for start in np.flatnonzero(pieces.fits):
            owner = pieces.owner[start]
            found[int(pieces.rows[owner]), start - pieces.at[owner] + offsets[owner]] += 1
        begin, end, rows = pieces.phrases()
        assert sorted(x for a, b in zip(begin, end) for x in range(a, b)) == np.flatnonzero(pieces.fits).tolist()
        place = suffixes.anchors(pieces.hash)
        for start in np.flatnonzero(pieces.fits)[:300]:
            own = pieces.hash[start : start + suffixes.PLACES] >> np.uint64(22)
            assert place[start] == start + int(np.argmin(own))
    assert found == Counter({(row, k): 1 for row in (1, 3) for k in range(len(data) - 49)})


# 13


def search_by_hand(docs, items, k):
    def counts(text):
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))

    held = [(i, counts(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in counts(text).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i, item))
        out += [(item, r + 1, i, -s) for r, (s, _, i, _) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block, known", [(1 << 14, 200_000, 500_000), (4, 3, 0)])
def test_search_by_hand(spark, monkeypatch, shard, block, known):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "KNOWN_TERMS", known)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    draw = random.Random(shard)
    words = ["the", "of", "Cat", "dog", "é", "12", "x-y", "rare", "Zoo", "日本"]
    say = lambda n: " ".join(draw.choices(words, [9, 7, 3, 3, 1, 1, 1, 0.1, 0.3, 0.2], k=n))
    docs = [(draw.choice([i, i, 5, None]), say(draw.randint(0, 30))) for i in range(150)] + [(200 + i, t) for i, t in enumerate(ODD)] + [(300, "twin text"), (300, "twin text"), (301, "twin text")]
    items = [(1, "the cat the cat"), (1, "dog"), (None, "twin rare"), (2, None), (3, ""), (4, "nowhere"), (5, " ".join(words)), (6, "12 日本")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("n"), "item": F.lit("i"), "score": F.lit(0), "terms": F.lit("t")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("i"), "doc_id": F.lit("i"), "n": F.lit(1)})
    for k in (1, 20):
        assert sorted(map(tuple, search.search(d, i, k).collect()), key=str) == search_by_hand(docs, items, k)
    assert search.search(d.where("false"), i).count() == 0 and search.search(d, i.where("false")).count() == 0


def test_the_threshold_stops_early():
    """Of a list of many equal documents only the first places are read once nothing unread can be better."""
    n = 20_000
    impact = np.sort(np.random.default_rng(1).integers(1, 10**6, n))[::-1]
    looked = []

    class Counted(search.Shard):
        def scores(self, rows, weights):
            looked.append(len(rows))
            return super().scores(rows, weights)

    shard = Counted(np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64), impact.astype(np.int64), 1)
    none = np.zeros(0, np.int64)
    score, doc = shard.best(np.array([0]), np.array([3]), np.array([3]), (none, none), 20)
    assert doc.tolist() == list(range(20)) and (score == 3 * impact[:20]).all() and sum(looked) < 100


# The pipeline


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, odd texts and an empty table go through all five stages; no clean text is lost, whatever its id."""
    import shutil

    shutil.copytree(DATA, tmp_path / "in")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = docs.where("length(text) between 400 and 900").orderBy("doc_id").limit(12).collect()
    odd = [(None, clean[0].text, "en", "s0", 1), (None, clean[1].text, "en", None, 1), (7, clean[2].text, None, "s0", 1), (7, clean[3].text, "en", "s0", 1), (7, clean[3].text, "en", "s0", 1), (None, None, None, None, None), (8, "", "en", "s0", 0)]
    few = spark.createDataFrame(odd, docs.schema)
    out, none = few, docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, out, str(tmp_path / "in")), stage(spark, none, str(tmp_path / "in"))
        out.write.parquet(str(tmp_path / f"{name}.parquet"))
        none.write.parquet(str(tmp_path / f"{name}-none.parquet"))
        out, none = spark.read.parquet(str(tmp_path / f"{name}.parquet")), spark.read.parquet(str(tmp_path / f"{name}-none.parquet"))
        assert none.count() == 0
    kept = spark.read.parquet(str(tmp_path / "MinHash near-dedup.parquet"))
    assert {r.text for r in kept.collect()} == {c.text for c in clean[:4]} and kept.count() == 4
    assert {r.doc_id for r in out.collect()} == {None, 7}


def test_wrappers_keep_every_part_of_unlike_pages():
    """More parts than 64 (F4), the rare ones too; and wide lists are aligned with as many pairs as there can be."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    pages = [f"<body><div class=x{name(i)}><p>Text {i}</p></div><section><p>Story {i} goes on.</p><h2>Part</h2></section></body>" for i in range(100)]
    whole = html.page_tree(pages[0])
    for page in pages[1:]:
        whole = html.merged(whole, html.page_tree(page))
    body = whole.children[0]
    assert {c.key for c in body.children if c.name == "div"} == {f"div.x{name(i)}" for i in range(100)}
    assert sum(c.pages for c in body.children if c.name == "section") == 100
    rule = html.json.dumps(html.rules(whole))
    assert all(f"Story {i} goes on." in html.extract(page, rule) for i, page in enumerate(pages))
    a, b = [f"k{i * 7 % 90}" for i in range(200)], [f"k{i * 11 % 90}" for i in range(150)]
    pairs = html._longest(a, b)
    assert [i for i, _ in pairs if i is not None] == list(range(200)) and [j for _, j in pairs if j is not None] == list(range(150))
    table = [[0] * 151 for _ in range(201)]
    for i in range(200):
        for j in range(150):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (a[i] == b[j]))
    both = [(i, j) for i, j in pairs if i is not None and j is not None]
    assert len(both) == table[200][150] and all(a[i] == b[j] for i, j in both)
