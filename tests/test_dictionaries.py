"""The term automaton against a naive search, word pieces against a library of tokenizers, link contexts against a painter by definition."""

import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from veilworks.operators import links, terms, wordpiece
from veilworks.plans import tables


def naive(text, words):
    """Every place of every term, by trying all."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    kept = [i for i, c in enumerate(low) if c not in " \t"]
    squeezed, out = "".join(low[i] for i in kept), set()
    sharp = lambda c: c.isascii() and c.isalnum()
    for w in words:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w if c not in " \t")
        for at in range(len(squeezed) - len(t) + 1):
            if squeezed[at : at + len(t)] == t:
                a, b = kept[at], kept[at + len(t) - 1]
                if not (sharp(text[a]) and a and sharp(text[a - 1])) and not (sharp(text[b]) and b + 1 < len(text) and sharp(text[b + 1])):
                    out.add((a, b + 1))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("aAb é\t한-", max_size=30), st.lists(st.text("ab é한-", min_size=1, max_size=4).filter(str.strip), min_size=1, max_size=6))
def test_automaton_is_the_naive_search(text, words):
    own = ["".join(c for c in w if c not in " \t") for w in words]
    cs, ce = terms.Automaton(own).hits(text)
    assert set(zip(cs.tolist(), ce.tolist())) == naive(text, words)


def test_dictionary_rows(spark):
    docs = spark.createDataFrame([(1, "The Red fox, red  FOXES; redfox"), (1, "The Red fox, red  FOXES; redfox"), (None, "fox"), (2, None), (3, "")], "doc_id long, text string").withColumn("term", F.lit("x"))
    words = spark.createDataFrame([("red fox",), ("fox",), ("Fox",)], "term string")
    for chars in (terms.BLOCK_CHARS, 4):
        got = sorted((r.doc_id or 0, r.cs, r.ce, r.value) for r in terms.find_dictionary(docs, words, "T", block_chars=chars).collect())
        one = [(1, 4, 11, "Red fox"), (1, 8, 11, "fox"), (1, 25, 31, "redfox")]
        assert got == sorted([(0, 0, 3, "fox"), *one, *one])
    assert terms.find_dictionary(docs, words.where("false"), "T").count() == 0
    for wrong in (" ", None):
        with pytest.raises(ValueError, match="empty"):
            terms.find_dictionary(docs, spark.createDataFrame([(wrong,)], "term string"), "T")


def test_many_terms_take_one_pass():
    """50,000 terms take about the time of 50."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(8))
    text = " ".join(word() for _ in range(50_000))
    few, many = terms.Automaton([word() for _ in range(50)]), terms.Automaton([word() for _ in range(50_000)])
    took = []
    for own in (few, many):
        start = time.perf_counter()
        own.hits(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


PIECES = ["[UNK]", "un", "##aff", "##able", "af", "##f", "run", "##ning", "##s", ".", ",", "!", "日", "本", "é", "##é", "a", "##a", "b", "##b", "¿"]


@settings(max_examples=200, deadline=None)
@given(st.text("unafblerigs.,! \t\n 日本é​\x00¿ab", max_size=40))
def test_pieces_are_those_of_a_library(text):
    ids = {p: i for i, p in enumerate(PIECES)}
    own = Tokenizer(models.WordPiece(vocab=ids, unk_token="[UNK]", max_input_chars_per_word=100))
    own.normalizer, own.pre_tokenizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False), pre_tokenizers.BertPreTokenizer()
    want = own.encode(text)
    got = list(wordpiece.Pieces(ids, 0).encode(text))
    assert [i for i, _, _ in got] == want.ids
    assert ["".join(c for c in text[a:b] if c not in "​\x00") for _, a, b in got] == ["".join(c for c in text[a:b] if c not in "​\x00") for a, b in want.offsets]


def test_piece_rows(spark):
    docs = spark.createDataFrame([(1, "unaffable."), (1, "unaffable."), (None, "running"), (2, None), (3, ""), (4, "z" * 101)], "doc_id long, text string")
    known = spark.createDataFrame(list(zip(PIECES, range(len(PIECES)))), "piece string, id long")
    got = sorted((r.doc_id or 0, r["at"], r.id, r.cs, r.ce) for r in wordpiece.pieces(docs, known).collect())
    one = [(1, 0, 1, 0, 2), (1, 1, 2, 2, 5), (1, 2, 3, 5, 9), (1, 3, 9, 9, 10)]
    assert got == sorted([(0, 0, 6, 0, 3), (0, 1, 7, 3, 7), *one, *one, (4, 0, 0, 0, 101)])
    with pytest.raises(ValueError, match="unknown"):
        wordpiece.pieces(docs, known.where("id > 0"))
    w = wordpiece.windows(spark.createDataFrame([(1, "a b. " * 200)], "doc_id long, text string"), known).orderBy("at").collect()
    assert [(r.first, r.end) for r in w] == [(0, 252), (252, 504), (504, 600)]


def test_words_of_a_group_are_looked_up_once():
    own, asked = wordpiece.Pieces({p: i for i, p in enumerate(PIECES)}, 0), []
    look = own.of
    own.of = lambda word: asked.append(word) or look(word)
    assert len(list(own.encode("unaffable running " * 2000))) == 5 * 2000
    assert sorted(asked) == ["running", "unaffable"]


@pytest.mark.parametrize("most", [1, 7, 30])
def test_parts_of_texts_give_the_pieces_of_the_whole(most, monkeypatch):
    text = "running. unaffable\n\x00 un. running unaffable. " * 3
    ids = {p: i for i, p in enumerate(PIECES)}
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 6, 7, 8], "text": [text, None, "un", text[:40]]})
    sent = type("Sent", (), {"value": (ids, 0)})
    of = lambda run: [r for b in run(sent)(iter([batch])) for r in b.to_pylist()]
    whole = of(wordpiece._pieces), of(wordpiece._cuts)
    monkeypatch.setattr(wordpiece, "CHARS", most)
    assert (of(wordpiece._pieces), of(wordpiece._cuts)) == whole
    assert [r["n"] for r in whole[1]] == [sum(r["doc_id"] == k for r in whole[0]) for k in (5, 6, 7, 8)]


def by_definition(text):
    """Contexts by painting character after character, in quadratic time."""
    n, space = len(text), " \t\n\r\f\v"
    paint = [[None] * n for _ in range(5)]
    letter = lambda c: c.isascii() and c.isalpha()
    i = 0
    while i < n:
        low, size = text[i:].lower(), 0
        if text[i] == "<":
            size = 1
        else:
            size = next((len(f) for f in ("&lt;", "&#60;", "&#x3c;") if low.startswith(f)), 0)
        after = text[i + size : i + size + 1]
        if size and after and (letter(after) or after in "/!"):
            j, end = i + size, n
            while j < n:
                if text[j] in "\"'":
                    close = text.find(text[j], j + 1)
                    j = n if close < 0 else close + 1
                elif text[j] == ">":
                    end = j + 1
                    break
                elif size > 1 and text[j:].lower().startswith("&gt;"):
                    end = j + 4
                    break
                else:
                    j += 1
            paint[0][i:end] = ["html_tag"] * (end - i)
            i = end
        elif size == 1 and after and after not in space:
            j = i + 1
            while j < n and text[j] not in ">\n":
                j += 1
            end = j + 1 if j < n and text[j] == ">" else j
            paint[0][i:end] = ["angle_bracket"] * (end - i)
            i = end
        else:
            i += 1
    at = 0
    while (at := text.find("](", at)) >= 0:
        depth, j = 0, at + 2
        while j < n:
            if text[j] == "\\":
                j += 1
            elif text[j] == "(":
                depth += 1
            elif text[j] == ")":
                if not depth:
                    break
                depth -= 1
            j += 1
        j = min(j, n)
        paint[1][at + 2 : j] = ["markdown_destination"] * max(j - at - 2, 0)
        at = max(j, at + 2)
    start = 0
    for line in text.split("\n"):
        lead = len(line) - len(line.lstrip(" "))
        close = line.find("]", lead + 1)
        if lead <= 3 and line[lead : lead + 1] == "[" and close >= 0 and line[close + 1 : close + 2] == ":":
            for k in range(start + close + 2, start + len(line)):
                paint[2][k] = "markdown_reference"
        start += len(line) + 1
    i = 0
    while i < n:
        word = i and text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] == "-")
        low, end = text[i:].lower(), i
        if not word and low.startswith(("url(", "image-set(")):
            close = text.find(")", i)
            end = n if close < 0 else close + 1
        elif not word and low.startswith("@import"):
            close = text.find("\n", i)
            end = n if close < 0 else close
        paint[3][i:end] = ["css_url"] * (end - i)
        i = max(end, i + 1)
    region, floor, at = [0] * n, 0, 0
    while (at := text.find("](", at)) >= 0:
        open_ = at
        while open_ > floor and text[open_ - 1] not in "[\n":
            open_ -= 1
        if open_ > floor and text[open_ - 1] == "[":
            region[open_:at] = [at + 1] * (at - open_)
        floor = at = at + 2
    i = 0
    while i < n:
        if text[i] in space:
            i += 1
            continue
        j = i
        while j < n and text[j] not in space and region[j] == region[i]:
            j += 1
        kind = links._run_kind(text[i:j])
        paint[4][i:j] = [kind] * (j - i)
        i = j
    out = []
    for m in links.TOKEN.finditer(text):
        out.append(next((p[k] for k in range(*m.span()) for p in paint if p[k]), None))
    return out


BITS = ["⟦EMAIL_0123456789⟧", "<", ">", "<a ", "</", "<!", "&lt;b ", "&gt;", '"', "'", "](", ")", "(", "\\", "[", "]:", "[x]: ", "\n", " ", "url(", "image-set(", "@import ", "://", "mailto:", "www.", "h.example/", "x", "-", "data:", "a.bc?"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_contexts_are_those_of_the_definition(text):
    assert links.contexts(text) == by_definition(text)


@pytest.mark.parametrize("bit", ["<", "](", '<a "', "&lt;b ", "[", "url(", "a.", "www.", "[x]:\n"])
def test_contexts_take_linear_time(bit):
    text = bit * ((1 << 20) // len(bit)) + BITS[0]
    start = time.perf_counter()
    links.contexts(text)
    assert time.perf_counter() - start < 10


def test_table_functions_tell_rows_apart(spark):
    docs = spark.createDataFrame([(3, "a@mail.example.org"), (3, "card 4111 1111 1111 1111"), (None, "b@mail.example.org"), (4, None)], "doc_id long, text string")
    tables.register(spark, docs, "t_")
    docs.createOrReplaceTempView("t_docs")
    got = spark.sql("SELECT d.doc_id, e.value, j.code FROM t_docs d, LATERAL t_judge_text(d.doc_id, d.text) j LEFT JOIN LATERAL t_find_entities(d.doc_id, d.text) e").collect()
    assert {tuple(r) for r in got} == {(3, "a@mail.example.org", None), (3, "4111111111111111", 400), (None, "b@mail.example.org", None), (4, None, None)}
    said = spark.sql("SELECT c.at, c.context FROM (SELECT '<a ⟦EMAIL_0123456789⟧> ⟦EMAIL_0123456789⟧' AS text) d, LATERAL t_token_contexts(d.text) c").collect()
    assert {tuple(r) for r in said} == {(0, "html_tag"), (1, None)}
