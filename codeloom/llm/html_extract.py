"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tokens: words and tags, in page order. A word scores the log odds of being content (by
whether it is linked, and whether it is one that boilerplate keeps saying), a tag minus what one costs, all learnt from
labelled pages (labelled_pages.py). Class, id and role names are learnt too, word by word: a name of nothing but what
boilerplate is called makes its element boilerplate, while a word that was never seen speaks for content, as in
``share-price``. Boilerplate by element (nav, aside, form, a page's header and footer, ...) or by name is taken out of the
sequence, so that it parts nothing; inside an article or main element tags cost nothing and all words score as prose.

A linear scan finds all maximal-scoring contiguous regions. The text is the best one, and with it the regions that
stand in the same element as some of it or score a fifth of it at least: the parts of one text with a list of links in
between. Where most of these words are in article or main elements, only those elements count.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two newlines.
Nulls: a null or blank page, or one without content, gives an empty text. Broken pages (unclosed, cut off, with stray
quotes) are read as far as they go. Rows are independent; repeated rows give repeated results; extra columns are left
alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is no part of a page's prose, elements that are no content, elements that begin a
#: block, elements without an end.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold blocks beside one another.
HOLDER = {"article", "body", "center", "div", "html", "main", "section", "td"}
#: A quoted value ends where an attribute can end; a tag with a stray quote ends at the first >.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[^<]+|<", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W_]+")
#: Words of names that say less are left out: left, box, page.
WEAK = 1.0
#: Share of the best region's score from which another region is text as well.
SHARE = 0.2


@dataclass
class Model:
    """weights: of words and tags by kind; names: log odds of content of names and their words, unknown: of any other
    word; boilerplate: words that it keeps saying."""

    weights: dict[str, float]
    names: dict[str, float] = field(default_factory=dict)
    unknown: float = 0.0
    boilerplate: frozenset[str] = frozenset()

    def __post_init__(self):
        self.odds = lru_cache(50_000)(self._odds)

    def __reduce__(self):
        return Model, (self.weights, self.names, self.unknown, self.boilerplate)

    def _odds(self, name: str) -> float:
        whole = "=" + "-".join(name_words(name))
        if whole in self.names:
            return self.names[whole]
        odds = [self.names.get(w, self.unknown) for w in name_words(name)]
        return sum(x for x in odds if abs(x) >= WEAK)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in NAME_WORD.findall(name)]


class Block:
    """tags: how many stand before or in it outside boilerplate; noisy: it is boilerplate by element or name; linked:
    words in links; held: in an article or main; place: its element, holder: the number of the one that holds it; names:
    (number, name) of the elements around it; soft: noisy by a name only."""

    __slots__ = ("parts", "tags", "noisy", "linked", "words", "place", "held", "holder", "names", "soft")

    def __init__(self, top: Open | None):
        self.parts: list[str] = []
        self.tags = self.linked = self.words = 0
        self.noisy, self.held, self.place, self.holder, self.names, self.soft = (top.noisy, top.held, top.name, top.holder, top.names, top.soft) if top else (False, False, "", 0, (), False)

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Open:
    """An open element."""

    __slots__ = ("name", "noisy", "held", "holder", "names", "soft")

    def __init__(self, name: str, noisy: bool, held: bool, holder: int, names: tuple, soft: bool):
        self.name, self.noisy, self.held, self.holder, self.names, self.soft = name, noisy, held, holder, names, soft


def named_noise(name: str, names: list[str], held: bool, model: Model) -> bool:
    """Whether an element is boilerplate by its names."""
    if name in ("html", "body", "main") or not names:
        return False
    odds = [model.odds(n) for n in names if not (held and name_words(n)[-1:] in (["header"], ["footer"]))]
    if name == "article":  # its other names tell of what it may have
        return bool(odds) and odds[0] < 0 and max(odds) < 0
    return any(x < 0 for x in odds)


def blocks(page: str | None, model: Model, forms: bool = True, soft: bool = True) -> list[Block]:
    """The blocks of a page that hold text, in page order. forms: whether a form is boilerplate; soft: whether names
    make an element that."""
    out: list[Block] = []
    stack: list[Open] = []
    now = Block(None)
    pending = links = count = 0

    def begin() -> None:
        nonlocal now, pending
        if any(p.strip() for p in now.parts):
            out.append(now)
            pending = 0
        now = Block(stack[-1] if stack else None)
        now.tags = pending

    at, text = 0, page or ""
    while m := TOKEN.match(text, at):
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0][:1] != "<" or m[0] == "<":
                piece = html.unescape(m[0])
                now.parts.append(piece)
                n = len(piece.split())
                now.words += n
                now.linked += n * bool(links)
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not (stack and stack[-1].noisy):
            pending += 1
            now.tags += 1
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(text, at)
                at = end.end() if end else len(text)
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in BLOCK and name not in ASIDE:
            continue
        if name in VOID:
            begin()
            continue
        if closing:
            if any(o.name == name for o in stack):
                while stack.pop().name != name:
                    pass
        else:
            while stack and stack[-1].name == "p" or name == "li" and stack and stack[-1].name == "li":
                stack.pop()  # a paragraph ends where a block begins
            top = stack[-1] if stack else Open("", False, False, 0, (), False)
            count += 1
            given = [x for g in NAMES.findall(attributes) for x in next(filter(None, g), "").split()]
            hard = name in ASIDE and (name != "form" or forms) and not (name == "header" and top.held)
            by_name = soft and not hard and not top.noisy and named_noise(name, given, top.held, model)
            names = (*top.names, *((count, x) for x in given)) if given and name not in ("html", "body") else top.names
            stack.append(Open(name, top.noisy or hard or by_name, top.held or name in ("article", "main"), count if name in HOLDER else top.holder, names, top.soft or by_name))
        links = 0
        begin()
    begin()
    return out


def features(b: Block, model: Model) -> dict[str, int]:
    """How many words and tags of each kind a block has."""
    flow = "list-tag" if b.place in ("li", "td", "dd") else "flow-tag"
    if b.words and b.linked * 2 > b.words:
        return {"linked-word": b.words, flow: b.tags}
    said = sum(w in model.boilerplate for w in WORD.findall(b.text().lower())) if model.boilerplate else 0
    said = min(said, b.words)
    return {"plain-word": b.words - said, "boilerplate-word": said, flow: b.tags}


def train(pages: list[tuple[str, list[str]]]) -> Model:
    """What labelled pages (html, the texts of its content blocks) teach: names and words first, then weights."""
    bare = Model({})
    elements: dict[bool, Counter] = {True: Counter(), False: Counter()}
    said: dict[bool, dict[str, set[int]]] = {True: defaultdict(set), False: defaultdict(set)}
    for at, (page, content) in enumerate(pages):
        named: dict[tuple[int, str], bool] = {}
        for b in blocks(page, bare):
            inside = b.text() in content
            for key in b.names:
                named[key] = named.get(key, False) or inside
            for w in WORD.findall(b.text().lower()):
                said[inside][w].add(at)
        for (_, name), inside in named.items():
            elements[inside].update({*(words := name_words(name)), "=" + "-".join(words)})
    sizes = {side: sum(c.values()) + 1 for side, c in elements.items()}
    # words never seen: as likely on a side as words that it has once (Good and Turing)
    once = {side: (sum(n == 1 and w[0] != "=" for w, n in c.items() if w) + 0.5) / sizes[side] for side, c in elements.items()}
    unknown = max(0.0, math.log(once[True] / once[False]))
    names = {w: math.log((elements[True][w] + 0.5) / sizes[True]) - math.log((elements[False][w] + 0.5) / sizes[False]) for w in elements[True] | elements[False]}
    boilerplate = frozenset(w for w, where in said[False].items() if len(where) >= 3 and w not in said[True])
    model = Model({}, names, unknown, boilerplate)
    inside, outside = Counter(), Counter()
    for page, content in pages:
        for b in blocks(page, bare):
            (inside if b.text() in content else outside).update(features(b, model))
    for f in ("plain-word", "linked-word", "boilerplate-word", "flow-tag", "list-tag"):
        odds = math.log((inside[f] + 0.5) / (outside[f] + 0.5))
        # Words of prose are positive and tags negative whatever a small training set says.
        model.weights[f] = max(odds, 0.1) if f == "plain-word" else min(odds, -0.1)
    return model


@lru_cache(1)
def default_model() -> Model:
    from codeloom.llm.labelled_pages import TRAINING, labelled_pages

    return train(labelled_pages(TRAINING))


def maximal_regions(scores: list[float]) -> list[tuple[float, int, int]]:
    """(sum, first, behind the last) of all maximal-scoring contiguous regions, in one scan (Ruzzo and Tompa)."""
    found: list[tuple[float, float, int, int, int]] = []  # sums before and behind it, ends, the nearest one with a smaller sum before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first = i
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= before:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                found.append((before, total, first, i + 1, k))
                break
            before, first = found[k][0], found[k][2]
            del found[k:]
    return [(after - before, a, b) for before, after, a, b, _ in found]


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """(first, behind the last) of the run of blocks with the greatest sum; a block is (its tags' score, its words')."""
    regions = maximal_regions([x for pair in scores for x in pair])
    if not regions:
        return 0, 0
    _, a, b = max(regions, key=lambda r: (r[0], -r[1]))
    return a // 2, (b + 1) // 2


def main_blocks(found: list[Block], model: Model) -> list[Block]:
    """The blocks of the main text among those that aren't boilerplate."""
    found = [b for b in found if not b.noisy]
    scores: list[float] = []
    for b in found:
        if b.held:
            scores += [0.0, b.words * model.weights["plain-word"]]
        else:
            counts = features(b, model)
            scores += [sum(n * model.weights[f] for f, n in counts.items() if f.endswith(kind)) for kind in ("tag", "word")]
    regions = [(x, a // 2, (b + 1) // 2) for x, a, b in maximal_regions(scores)]
    if not regions:
        return []
    best, a, b = max(regions, key=lambda r: (r[0], -r[1]))
    holders = {x.holder for x in found[a:b]}
    kept = [x for score, i, j in regions if score >= SHARE * best or any(y.holder in holders for y in found[i:j]) for x in found[i:j]]
    held = [x for x in kept if x.held]
    return held if 2 * sum(x.words for x in held) >= sum(x.words for x in kept) else kept


def extract(page: str | None, model: Model | None = None) -> str:
    model = model or default_model()
    found = blocks(page, model)
    if "<form" in (page or "").lower():
        opened = blocks(page, model, forms=False)
        if 2 * sum(b.words for b in found if not b.noisy) < sum(b.words for b in opened if not b.noisy):
            found = opened  # a form around most of the page is a frame of it
    kept = main_blocks(found, model)
    if not kept and any(b.soft and b.held for b in found):
        kept = main_blocks(blocks(page, model, soft=False), model)  # an article in a frame with an ill-chosen name
    return "\n\n".join(b.text() for b in kept)


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, model) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
