"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised (lower case, runs of white space as one space, trimmed). An item of m characters
may have m // BUDGET_CHARS edits. It is cut into one piece more than that, so that whatever the edits, one piece stays
whole; an Aho-Corasick automaton finds all pieces of all items in one scan over each whole text. Around every hit a
window that must hold the item is verified with Myers' bit-parallel distance of the item to its best place there, if
it has as many of the item's trigrams as that many edits must leave.

Items are a stated query set: they are broadcast in blocks of at most BLOCK_CHARS characters, each of which scans all
documents; a worker builds a block's automaton once. Items of fewer than LEAST_CHARS characters, normalised, are left
out: nearly every document holds them. Nulls and blanks: a null or blank text or item matches nothing. A null doc_id is kept. Repeated rows give
repeated results; of several places of an item in a text the nearest, then first one is given. Extra columns are left
alone.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import batch, materialise, row_key

#: One edit is allowed for so many characters of an item.
BUDGET_CHARS = 12
BLOCK_CHARS = 8_000_000
LEAST_CHARS = 8
MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.binary())])
MATCHES_DDL = "doc_id long, item_id long, distance int, start long, end long, key binary"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 of nearly the same length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of item to any stretch of text, and where the first such stretch ends."""
    m = len(item)
    if masks is None:
        masks = masks_of(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a stretch may begin anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def start_of(item: str, text: str, end: int, budget: int) -> int:
    """Where the best stretch that ends there begins: the same search backwards."""
    back = text[max(0, end - len(item) - budget) : end][::-1]
    best, at = len(item) + 1, 0
    m, rev = len(item), item[::-1]
    # rows of plain dynamic programming, anchored at the end; only matches come here
    row = list(range(m + 1))
    for j, c in enumerate(back, 1):
        last, row[0] = row[0], j
        for i in range(1, m + 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (rev[i - 1] != c))
        if row[m] <= best:
            best, at = row[m], j
    return end - at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], budget_chars: int):
        self.items = items
        self.budget = [len(t) // budget_chars for _, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        self.trigrams: dict[int, set[str]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.budget[i]):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end), one for each item within its budget."""
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (n, where) in self.automaton.iter(text):
            for i, offset in where:
                begins[i].add(end - n + 1 - offset)
        out = []
        for i, starts in begins.items():
            item, k = self.items[i][1], self.budget[i]
            m = len(item)
            if (at := text.find(item)) >= 0:
                out.append((i, 0, at, at + m))
                continue
            if not k:
                continue
            masks = self.masks.get(i) or self.masks.setdefault(i, masks_of(item))
            grams = self.trigrams.get(i) or self.trigrams.setdefault(i, trigrams(item))
            best = (k + 1, 0)
            lo = hi = -1
            for s in [*sorted(starts), None]:
                if s is not None and lo >= 0 and s - k <= hi:
                    hi = s + m + k
                    continue
                if hi >= 0 and len(grams & trigrams(text[lo:hi])) >= len(grams) - 3 * k:
                    d, at = myers(item, text[lo:hi], masks)
                    if d < best[0]:
                        best = (d, lo + at)
                if s is not None:
                    lo, hi = max(0, s - k), s + m + k
            if best[0] <= k:
                out.append((i, best[0], start_of(item, text, best[1], k), best[1]))
        return out


def contamination(docs: DataFrame, items: DataFrame, budget_chars: int = BUDGET_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every item found in a document; places in the normalised text."""
    return _found(docs, items, budget_chars, block_chars, F.lit(None).cast("binary")).drop("key")


def _found(docs: DataFrame, items: DataFrame, budget_chars: int, block_chars: int, key: Column) -> DataFrame:
    """The matches, with the key of each one's document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    size = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = size // block_chars + 1
    out = None
    for b in range(blocks):
        block = [(r.item_id, normalise(r.text)) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        found = _scan(docs, sorted([x for x in block if len(x[1]) >= LEAST_CHARS], key=lambda x: (x[0] is None, x[0] or 0, x[1])), budget_chars)
        if blocks > 1:
            found = materialise(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCHES_DDL)


#: The matcher of the block that this worker has scanned last, by the block's name.
_matchers: dict[str, Matcher] = {}


def _matcher(name: str, block: list[tuple[int, str]], budget_chars: int) -> Matcher:
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(block, budget_chars)
    return _matchers[name]


def _scan(docs: DataFrame, block: list[tuple[int, str]], budget_chars: int) -> DataFrame:
    held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, held.value, budget_chars) if held.value else None
        for b in batches:
            rows = []
            for doc, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if matcher and text:
                    rows += [(doc, matcher.items[i][0], d, s, e, key) for i, d, s, e in matcher.match(normalise(text))]
            if rows:
                yield batch(MATCHES, dict(zip(MATCHES.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.mapInArrow(scan, MATCHES_DDL)


def decontaminate(docs: DataFrame, items: DataFrame, budget_chars: int = BUDGET_CHARS) -> DataFrame:
    """docs without those that hold an item. Each row is judged by its own text, also where ids are null or repeated."""
    bad = materialise(_found(docs, items, budget_chars, BLOCK_CHARS, row_key()).select(F.col("key").alias("__bad")).distinct(), "leaks")
    return docs.join(bad, row_key() == F.col("__bad"), "left_anti")
