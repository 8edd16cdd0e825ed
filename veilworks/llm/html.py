"""HTML extraction: wrappers of a host's pages, inferred by aligning token streams, say which text slots hold the article."""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.llm.common import arrow_rows, cut, small_batches, table

#: Hosts whose wrappers a task holds before it passes them on, and the parts in which those of a host are merged first.
HOSTS, SALTS = 2000, 64
#: Bytes of all rules up to which they are broadcast; more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Pages after which a text that never changed may be the template's; it is if it stands beside so many different articles.
TEMPLATE_PAGES = 5
#: Texts whose articles a task holds before it passes them on.
TEXTS = 20_000
#: Siblings that a repeated group may have; levels that tell two parts apart.
GROUP, DEPTH = 4, 3
#: Pairs of parts of two lists up to which all are weighed; up to which the most parts of equal keys are aligned, all pairs at once.
WEIGHED, CELLS = 64 * 64, 1 << 22
#: Share of its container's varying text that a part must hold for the article to be sought in it; that an article or main element must hold.
MAIN_SHARE, MARKED_SHARE = 0.8, 0.3
#: Weight of a text that never changes, and of one in an element whose class says that it isn't the article, when the container is sought.
CONSTANT_WEIGHT, UNWANTED_WEIGHT = 0.01, 0.1
#: Share of a repeated part's text that lies in links, and of the pages that have it, for it to be a menu.
LINK_SHARE, MENU_PAGES = 0.8, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select|object|xmp"
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends: the open elements of these names, up to one that holds them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table body html article section div blockquote main aside nav header footer form".split())
NEVER = frozenset("nav footer aside form menu dialog button head label".split())
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|menu\w*|nav\w*|breadcrumbs?|sidebar|side|widgets?|footer|"
    r"masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|reactions?|shar(?:e|ing)|social|related|recommend\w*|login|signup|signin|search|pagination|pager|skip|copyright|legal|toolbar|hidden)(?:$|[-_\s])", re.I
)
#: Within the article, elements that hold what isn't its text; a paragraph, heading or list item of such a class stays.
INSERTED = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|reactions?|shar(?:e|ing)|social|related|newsletter|subscri\w+|cookies?\w*|breadcrumbs?|sidebar)(?:$|[-_\s])", re.I)
#: Words that may stand beside those of INSERTED in a class of such an element; with any other word, as in social-impact or related-work, the class says what the text is about, and the text stays.
FITTINGS = frozenset(
    "ad ads area bar block body bottom box btn button buttons card container content count counter embed feed form foot footer group header heading icon icons inline inner item items js label link links list main mobile module outer panel "
    "post posts article articles story stories row section signup site slot small stack sticky tag tags title tool tools top unit widget wrap wrapper wide zone left right center disclosure label message thread reply replies user users reader".split()
)
#: Elements whose words are part of the sentence that they stand in.
WITHIN_PROSE, SENTENCES = frozenset("button label".split()), frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption article main body html".split())
#: Containers in which an article may lie, even if they hold nothing but text.
GENERIC = frozenset("html body div section article main td th table tbody tr center".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z][-a-zA-Z]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")


def key_of(name: str, attrs: str) -> str:
    """An element as wrappers know it: its name, id and classes, digits left out; with ! if a reader wouldn't see it."""
    if not attrs.strip():
        return name
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    gone = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    marks = re.sub(r"\d+", "", " ".join(x for x in (found.get("id"), found.get("class"), found.get("role")) if x)).split()
    return name + "".join(f".{m}" for m in marks) + "!" * gone


def slots(page: str | None) -> list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """The texts of a page in order: the keys of the elements around each, the raw text, a number that neighbours share if they are in one block, and the places of those elements among the page's."""
    out, stack, names, block, opened, serials = [], [], [], 0, 0, []

    def close(upto: int) -> None:
        nonlocal block
        block += any(n in BLOCKS for n in names[upto:])
        del stack[upto:], names[upto:], serials[upto:]

    for m in TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            out.append((tuple(stack), text, block, tuple(serials)))
        elif (name := (m["name"] or "").lower()):
            if m["end"]:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == name:
                        close(i)
                        break
                    if name not in BLOCKS and names[i] in BLOCKS:  # the end of an inline element whose block has ended
                        break
                continue
            if name in BLOCKS and "p" in names:
                close(len(names) - 1 - names[::-1].index("p"))
            if name in ENDS:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] in ENDS[name]:
                        close(i)
                    elif names[i] in HOLDS:
                        break
            block += name in BLOCKS
            if name == "br":
                out.append((tuple(stack), " ", block, tuple(serials)))
            if name not in VOID and not m["attrs"].endswith("/"):
                stack.append(key_of(name, m["attrs"]))
                names.append(name)
                opened += 1
                serials.append(opened)
    return out


@dataclass
class Node:
    """A part of a wrapper. A text slot (key #) keeps its text for as long as all pages agree; `many` marks a repeated part, `pages` below the parent's an optional one.

    Of a page, `places` are the slots that a text has, or the elements that a part has, among the page's.
    """

    key: str
    pages: int = 1
    many: bool = False
    text: str | None = None
    chars: int = 0
    links: int = 0
    children: list[Node] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def packed(self, depth: int = 1 << 30) -> list:
        return [self.key, self.pages, int(self.many), self.text, self.chars, self.links, [c.packed(depth - 1) for c in self.children] if depth else []]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], x[1], bool(x[2]), x[3], x[4], x[5], [Node.unpacked(c) for c in x[6]])

    @property
    def name(self) -> str:
        return self.key.partition(".")[0].rstrip("!")

    def shape(self, depth: int = DEPTH) -> frozenset:
        """The paths of keys below the node."""
        out = set()
        for c in self.children:
            out.add((c.key,))
            if depth > 1:
                out.update((c.key, *path) for path in c.shape(depth - 1))
        return frozenset(out)

    def leaf(self) -> bool:
        return not any(c.name in BLOCKS or c.key[0] == "(" or not c.leaf() for c in self.children if c.key != "#")


def page_tree(page: str | None) -> Node:
    """A page's token stream as a wrapper of its own, repeated parts folded."""
    return _tree(slots(page))


def _tree(found: list) -> Node:
    root, path, open_ = Node("/"), (), []
    for place, (keys, text, _, serials) in enumerate(found):
        said = " ".join(text.split())
        if not said:
            continue
        same = 0
        while same < min(len(serials), len(path)) and serials[same] == path[same]:
            same += 1
        del open_[same:]
        for key, serial in zip(keys[same:], serials[same:]):
            node = Node(key, places=[serial])
            (open_[-1] if open_ else root).children.append(node)
            open_.append(node)
        path = serials
        linked = len(said) if any(k == "a" or k.startswith("a.") for k in keys) else 0
        held = said if len(said) <= 64 else hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        (open_[-1] if open_ else root).children.append(Node("#", text=held, chars=len(said), links=linked, places=[place]))
        for node in (root, *open_):
            node.chars += len(said)
            node.links += linked
    return folded(root)


def same_kind(a: Node, b: Node) -> bool:
    """Whether neighbours may be one repeated part: containers are if they are built alike."""
    return a.key == b.key and (a.key == "#" or a.name not in GENERIC or a.name in ("tr", "td", "th") or (a.leaf() and b.leaf()) or a.shape() == b.shape())


def folded(node: Node) -> Node:
    """node with neighbouring parts of one kind, and groups of up to GROUP parts that repeat, each made one repeated part."""
    node.children = [folded(c) for c in node.children]
    for size in range(1, GROUP + 1):
        out: list[Node] = []
        i, old = 0, node.children
        while i < len(old):
            own = old[i : i + size]
            n = 1
            while len(own) == size == len(old[i + n * size : i + (n + 1) * size]) and all(map(same_kind, own, old[i + n * size : i + (n + 1) * size])):
                n += 1
            if n == 1 or size > 1 and len({c.key for c in own}) == 1:
                out.append(old[i])
                i += 1
                continue
            for k in range(1, n):
                own = [merged(a, b, within=True) for a, b in zip(own, old[i + k * size : i + (k + 1) * size])]
            whole = own[0] if size == 1 else Node("(" + " ".join(c.key for c in own) + ")", chars=sum(c.chars for c in own), links=sum(c.links for c in own), children=own, places=[x for c in own for x in c.places])
            whole.many = True
            out.append(whole)
            i += n * size
        node.children = out
    return node


def likeness(a: Node, b: Node) -> float:
    """How well two parts of one key match: by what lies below them, by size, and, of texts, by being the same."""
    if a.key == "#":
        return 3.0 if a.text is not None and a.text == b.text else 1.0
    x, y = a.shape(), b.shape()
    size, other = a.chars / a.pages, b.chars / b.pages
    return 1.0 + len(x & y) / max(1, len(x | y)) + min(size, other) / max(size, other, 1)


def _longest(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """aligned() with as many pairs of equal keys as there can be."""
    number = {key: n for n, key in enumerate(dict.fromkeys(a + b))}
    x, y = (np.array([number[key] for key in keys]) for keys in (a, b))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (y == x[i]))[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i, j] == best[i + 1, j]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def aligned(left: list[Node], right: list[Node]) -> list[tuple[int | None, int | None]]:
    """The likeliest alignment of two lists of parts, in order: pairs of places, None where one list lacks the other's part."""
    a, b = [c.key for c in left], [c.key for c in right]
    if a == b:
        return [(i, i) for i in range(len(a))]
    if WEIGHED < len(a) * len(b) <= CELLS:
        return _longest(a, b)
    if len(a) * len(b) > CELLS:  # the longest runs of equal keys; each part stays, in a pair or alone
        out = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            out += list(zip(range(i, j), range(k, m))) if tag == "equal" else [(x, None) for x in range(i, j)] + [(None, y) for y in range(k, m)]
        return out
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    match = {(i, j): likeness(left[i], right[j]) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]}
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + match[i, j] if (i, j) in match else 0.0)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and (i, j) in match and best[i][j] == best[i + 1][j + 1] + match[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i][j] == best[i + 1][j]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def merged(a: Node, b: Node, within: bool = False) -> Node:
    """The least wrapper of both: slots where texts differ, optional parts where one has what the other lacks; no part is left out. within: of one page's repeated parts, which count as one."""
    pages = max(a.pages, b.pages) if within else a.pages + b.pages
    out = Node(a.key, pages, a.many or b.many, a.text if a.text == b.text else None, a.chars + b.chars, a.links + b.links, places=a.places + b.places if within else [])
    for i, j in aligned(a.children, b.children):
        out.children.append(merged(a.children[i], b.children[j], within) if i is not None and j is not None else a.children[i] if j is None else b.children[j])
    return out


def marked(key: str, words: re.Pattern) -> bool:
    """Whether an element's id, classes or role hold one of the words."""
    marks = key.partition(".")[2]
    return bool(marks and words.search(marks.replace(".", " ")))


def rules(wrapper: Node) -> dict:
    """What a wrapper says of its host's pages.

    levels: the parts beside which the article's container lies on each level from the top, and its
    place among them: ever that part in which MAIN_SHARE of the varying text lies. Texts that no page
    changes hardly count, nor do those of elements whose name or class says that they aren't the
    article. below: the container's own parts, if `drop` (menus) or `doubtful` (texts that never
    changed) name any of them, by their numbers in order.
    """
    varied = wrapper.pages >= TEMPLATE_PAGES

    def mass(node: Node, many: bool = False, all_alike: bool = False) -> float:
        if node.key == "#":
            constant = not all_alike and varied and node.text is not None and not (many or node.many) and node.pages >= TEMPLATE_PAGES
            return (node.chars - node.links) * (CONSTANT_WEIGHT if constant else 1.0)
        if node.name in NEVER or node.name == "header" or node.key.endswith("!"):
            return 0.0
        return sum(mass(c, many or node.many, all_alike) for c in node.children) * (UNWANTED_WEIGHT if node.name not in ("html", "body") and marked(node.key, UNWANTED) else 1.0)

    levels, at = [], wrapper
    while True:
        able = [c.key not in "#" and c.key[0] != "(" and not c.many and (c.name in GENERIC or not c.leaf()) for c in at.children]
        sizes, whole = [mass(c) * k for c, k in zip(at.children, able)], sum(map(mass, at.children))
        best = max(range(len(sizes)), key=sizes.__getitem__, default=None)
        best = best if best is not None and sizes[best] and sizes[best] >= MAIN_SHARE * whole else None
        for k, c in enumerate(at.children):  # an element that says that it is the article, if it holds much of what there is
            if able[k] and c.name in ("article", "main") and mass(c, all_alike=True) >= MARKED_SHARE * sum(mass(x, all_alike=True) for x in at.children) > 0:
                best = k
                break
        if best is None:
            break
        levels.append([[c.packed(DEPTH) for c in at.children], best])
        at = at.children[best]
    drop, doubtful, number = [], [], 0

    def look(node: Node, many: bool) -> None:
        nonlocal number
        own, number = number, number + 1
        many |= node.many
        if node.key == "#":
            if varied and node.text is not None and not many and node.pages >= TEMPLATE_PAGES:
                doubtful.append(own)
        elif node is not at and varied and many and node.links >= LINK_SHARE * node.chars and node.pages >= MENU_PAGES * at.pages:
            drop.append(own)
        for c in node.children:
            look(c, many)

    look(at, False)
    return {"levels": levels, "below": at.packed() if drop or doubtful else None, "drop": drop, "doubtful": doubtful}


@lru_cache(maxsize=512)
def _parsed(rule: str) -> tuple:
    found = json.loads(rule)
    return [([Node.unpacked(x) for x in parts], k) for parts, k in found["levels"]], found["below"] and Node.unpacked(found["below"]), frozenset(found["drop"]), frozenset(found["doubtful"])


def located(page: Node, rule: tuple) -> tuple[Node, dict[int, int]] | None:
    """The article's container in a page, found by aligning the page with its host's wrapper level by level, and the number in the wrapper of each text and element below it."""
    levels, below, _, _ = rule
    at = page
    for parts, k in levels:
        found = [j for i, j in aligned(parts, at.children) if i == k and j is not None]
        if not found:
            return None
        at = at.children[found[0]]
    numbers: dict[int, int] = {}

    def follow(node: Node, own: Node, number: int) -> None:
        for place in own.places:
            numbers[place if own.key == "#" else -1 - place] = number
        firsts, number = [], number + 1
        for c in node.children:
            firsts.append(number)
            number += _size(c)
        for i, j in aligned(node.children, own.children):
            if i is not None and j is not None:
                follow(node.children[i], own.children[j], firsts[i])

    if below:
        follow(below, at, 0)
    return at, numbers


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.children))


def extract(page: str | None, rule: str | None) -> str:
    """The main text of a page under its host's rule; a page that can't be aligned with it is judged by its own wrapper's."""
    return _text(slots(page), rule)[0]


def _text(found: list, rule: str | None, doubt: bool = False) -> tuple[str, list[tuple[int, str]]]:
    """The texts of the slots in the article's container, without what the rule drops; and the doubtful ones, which are left out if `doubt`."""
    tree = _tree(found)
    parsed = _parsed(rule) if rule else None
    where = parsed and located(tree, parsed)
    if not where:
        parsed = _parsed(json.dumps(rules(tree)))
        where = located(tree, parsed)
    if not where:
        return "", []
    at, numbers = where
    _, _, drop, doubtful = parsed
    inside, whole = set(at.places), at.key in ("/", "html", "body")
    blocks: dict[int, list[str]] = {}
    asked = []
    for place, (keys, text, block, serials) in enumerate(found):
        depth = next((d for d, x in enumerate(serials) if x in inside), None)
        if depth is None and at.key != "/":
            continue
        below = keys[(-1 if depth is None else depth) + 1 :]
        if inserted(below, not whole or any(k.partition(".")[0] in ("article", "main") for k in keys)):
            continue
        if any(numbers.get(-1 - x) in drop for x in serials) or numbers.get(place) in drop:
            continue
        if numbers.get(place) in doubtful and text.strip():
            asked.append((numbers[place], " ".join(text.split())))
            if doubt:
                continue
        blocks.setdefault(block, []).append(text)
    said = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(x for x in said if x), asked


def known_as_inserted(key: str) -> bool:
    """Whether a class or id of an element says, as a whole, that it isn't the article's text."""
    for mark in key.split(".")[1:]:
        words = [w for w in re.split(r"[-_]+", mark.lower().rstrip("!")) if w]
        if any(INSERTED.fullmatch(w) for w in words) and all(INSERTED.fullmatch(w) or w in FITTINGS for w in words):
            return True
    return False


def inserted(below: tuple[str, ...], in_article: bool) -> bool:
    """Whether an element between the container and a text is known for what isn't the article's text. A word in a class that may as well say what the text is about is left to the wrapper, which drops what never varies and what is a menu."""
    sentence = False
    for key in below:
        name = key.partition(".")[0].rstrip("!")
        if key.endswith("!") or name in NEVER and not (sentence and name in WITHIN_PROSE) or name == "header" and not in_article:
            return True
        if name not in PROSE and (known_as_inserted(key) if in_article else marked(key, UNWANTED)):
            return True
        sentence |= name in SENTENCES
    return False


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Node] = {}
    task = TaskContext.get()
    salt = task.partitionId() % SALTS if task else 0
    for batch in arrow_rows(batches, 256):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = page_tree(page)
            held[host] = merged(held[host], tree) if host in held else tree
        if len(held) > HOSTS:
            yield _sent(held, salt)
            held = {}
    if held:
        yield _sent(held, salt)


def _sent(held: dict[str, Node], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(n.packed()) for n in held.values()])], ["host", "salt", "wrapper"])


def _together(rows: pd.DataFrame) -> Node:
    found = None
    for packed in sorted(rows["wrapper"]):
        node = Node.unpacked(json.loads(packed))
        found = node if found is None else merged(found, node)
    return found


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(_together(rows).packed())]})


def _rules(rows: pd.DataFrame) -> pd.DataFrame:
    rule = rules(_together(rows))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "rule": [json.dumps(rule)], "doubtful": [bool(rule["doubtful"])]})


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to TEMPLATE_PAGES different articles beside which each text that may be the template's stands: in a task so many are enough to know that there are so many in all."""
    held: dict[tuple[str, int, str], set[int]] = {}

    def sent() -> pa.RecordBatch:
        rows = [(*at, article) for at, articles in held.items() for article in articles]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["host", "number", "said", "article"])

    for batch in arrow_rows(batches, 256):
        for host, page, rule in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("rule").to_pylist()):
            said, asked = _text(slots(page), rule, doubt=True)
            if not asked:
                continue
            article = int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            for number, text in asked:
                known = held.setdefault((host, number, text), set())
                if len(known) < TEMPLATE_PAGES:
                    known.add(article)
        if len(held) > TEXTS:
            yield sent()
            held.clear()
    if held:
        yield sent()


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules in which the doubtful texts that proved the template's are dropped, and the others aren't doubted."""
    for batch in batches:
        out = []
        for rule, fixed in zip(batch.column("rule").to_pylist(), batch.column("fixed").to_pylist()):
            found = json.loads(rule)
            found["drop"], found["doubtful"] = found["drop"] + sorted(fixed or []), []
            if not found["drop"]:
                found["below"] = None
            out.append(json.dumps(found))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "rule"])


def host_rules(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (host, rule). Each task aligns its own pages; the tasks' wrappers of a host are merged by parts, then together, so a host of any size meets as a few wrappers, each as wide as its pages are unlike.

    The wrappers say where the article's container is, and which slots below it may be the template's. Of
    copies of a page all slots look so; so a slot is the template's only if each of its texts stands
    beside TEMPLATE_PAGES different articles, an article being what is left of a page without the
    slots in question.
    """
    parts = pages.mapInArrow(_wrappers, "host string, salt int, wrapper string")
    merged_parts = parts.groupBy("host", "salt").applyInPandas(_merge, "host string, wrapper string")
    found = cut(merged_parts.groupBy("host").applyInPandas(_rules, "host string, rule string, doubtful boolean"))
    doubtful = found.where("doubtful").select("host", "rule")
    if not doubtful.limit(1).count():
        return found.select("host", "rule")
    asked = pages.join(small(doubtful), "host").select("host", "html", "rule")
    beside = asked.mapInArrow(_beside, "host string, number int, said string, article bigint").groupBy("host", "number", "said").agg(F.count_distinct("article").alias("articles"))
    fixed = beside.groupBy("host", "number").agg(F.min("articles").alias("articles")).where(F.col("articles") >= TEMPLATE_PAGES)
    fixed = fixed.groupBy("host").agg(F.collect_list("number").alias("fixed"))
    return found.join(fixed, "host", "left").select("host", "rule", "fixed").mapInArrow(_final, "host string, rule string")


def small(rules_: DataFrame) -> DataFrame:
    """rules_, to be broadcast if they are small."""
    size = rules_.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0  # one number
    return F.broadcast(rules_) if size <= BROADCAST_BYTES else rules_


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_rows(batches, 512):
        texts = [extract(page, rule) for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


def main_text(df: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each row of df: the article of the whole page, without markup and what surrounds it.

    All pages of a host are aligned into one union-free expression of tags, text slots, optional and
    repeated parts. It says where the article's container is: where the text that varies lies. Each page
    is aligned with the expression of its host to find its own. Texts in it that never change are the
    template's if they stand beside five different articles, so copies of a page or an article count
    once. Blocks are joined by an empty line; white space within one is a single space; character
    references are decoded. A null page has the empty text; a null url, or one without a host, belongs
    to a host of its own; repeated rows give equal rows; an empty table stays empty.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = small_batches(df).select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"))
    found = small(cut(host_rules(rows.select("host", "html"))))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.join(found, "host", "left").select("id", "url", "html", "rule").mapInArrow(_extracted, f"id {kind}, url string, text string, n_chars bigint")
    return done.withColumnRenamed("id", key)


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
