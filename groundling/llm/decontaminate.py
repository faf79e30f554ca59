"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``n`` characters may differ from a passage by ``budget = n * error_rate`` edits.  It is split into
``budget + 1`` pieces, so a passage within the budget holds at least one piece unchanged.  One Aho-Corasick automaton
finds all pieces in a text; around each hit the item is verified with Myers' bit-parallel edit distance against any
substring.  Since of two halves with ``a`` and ``b`` pieces one is within ``a - 1`` or ``b - 1`` edits, a hit is verified
on the few pieces around it first, then on twice as many, up to the whole item; chance hits end at the first.  Case and white space do not count.  The items are the stated query set: they go to the tasks in blocks of
bounded size, each block against all rows, so nothing is joined or shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts_of, tidied

#: Share of an item's characters that may be edited; items shorter than this match exactly, on word borders, or else by chance.
ERROR_RATE, MIN_ITEM_CHARS = 0.1, 20
#: Characters of the items that one automaton holds at most (one longer item is a block of its own).
BLOCK_CHARS = 4_000_000
#: Bytes of patterns that a worker keeps at most, about; beyond that they are made anew.
PATTERN_BYTES = 64 << 20
_WORD = re.compile(r"\S+")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item for Myers' search: a bit per character."""

    def __init__(self, item: str):
        self.size, self.bits = len(item), defaultdict(int)
        for k, c in enumerate(item):
            self.bits[c] |= 1 << k

    def search(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(least distance to a substring, where it ends); ``anchored``: to a prefix.  Of equal ends the first counts."""
        mask, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score, best, end = mask, 0, self.size, self.size, 0
        get = self.bits.get
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & mask
            mh = mh << 1 & mask
            pv = mh | (mask & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, at
        return best, end


def _joined(text: str, at: int) -> bool:
    """Whether a word goes on over this place."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


class Items:
    """A block of items; built in the tasks, since the automaton is larger than the items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        import ahocorasick

        self.items, self.min_chars, found = [], min_chars, defaultdict(list)
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        self.held = 0
        for item_id, text in items:
            budget = int(len(text) * error_rate) if len(text) >= min_chars else 0
            parts = pieces(text, budget)
            for k, (_, piece) in enumerate(parts):
                found[piece].append((len(self.items), k))
            self.items.append((item_id, text, budget, [a for a, _ in parts] + [len(text)]))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.some = bool(found)

    def pattern(self, number: int, low: int, high: int) -> Pattern:
        """Of the pieces from ``low`` to before ``high``; made when first needed."""
        key = number, low, high
        found = self.patterns.get(key)
        if found is None:
            _, item, _, cuts = self.items[number]
            found = Pattern(item[cuts[low] : cuts[high]])
            size = 300 + len(found.bits) * (100 + found.size // 8)
            if self.held + size > PATTERN_BYTES:
                self.patterns, self.held = {}, 0
            self.patterns[key] = found
            self.held += size
        return found

    def likely(self, text: str, start: int, number: int, piece: int) -> bool:
        """Whether ever larger parts of the item around the piece, but for the whole, are within their share of edits."""
        cuts = self.items[number][3]
        for low, high in _halves(len(cuts) - 1, piece):
            edits = high - low - 1
            a, b = start - (cuts[piece] - cuts[low]) - edits, start + (cuts[high] - cuts[piece]) + edits
            if self.pattern(number, low, high).search(text[max(0, a) : b])[0] > edits:
                return False
        return True

    def matches(self, text: str, first_only: bool = False):
        """(item number, distance, start, end) of the best passage of each item found in a normalised text."""
        if not self.some:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            start = end - size + 1
            for number, piece in places:
                if size < self.min_chars and len(self.items[number][1]) < self.min_chars:  # a short item as a whole
                    if not (_joined(text, start) or _joined(text, end + 1)):
                        windows[number].append(start)
                elif self.likely(text, start, number, piece):
                    windows[number].append(start - self.items[number][3][piece])
        out = []
        for number, at in windows.items():
            _, item, budget, cuts = self.items[number]
            pattern, best = self.pattern(number, 0, len(cuts) - 1), None
            for low, high in _merged(at, budget, len(item)):
                d, end = pattern.search(text[max(0, low) : high])
                if d <= budget and (best is None or d < best[0]):
                    best = d, max(0, low) + end
                    if first_only:
                        return [(number, *best, best[1])]
            if best is not None:
                d, end = best
                _, back = Pattern(item[::-1]).search(text[max(0, end - len(item) - budget) : end][::-1], True)
                out.append((number, d, end - back, end))
        return out


@lru_cache(maxsize=None)
def _halves(n: int, piece: int) -> tuple[tuple[int, int], ...]:
    """The ranges that hold a piece when ``n`` pieces are halved again and again: smallest first, without itself and the whole."""
    low, high, out = 0, n, []
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if piece < mid else (mid, high)
        out.append((low, high))
    return tuple(out[-2::-1])


def _merged(starts: list[int], budget: int, size: int):
    """Windows of text in which the item may lie, those that overlap joined."""
    low = high = None
    for s in sorted(set(starts)):
        a, b = s - budget, s + size + budget
        if low is None:
            low, high = a, b
        elif a <= high:
            high = b
        else:
            yield low, high
            low, high = a, b
    if low is not None:
        yield low, high


def _spans(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Places in the text as it was of (start, end) in its normalised form."""
    marks, at = [], 0  # (place in the normalised text, place in the text, word)
    for m in _WORD.finditer(text):
        marks.append((at, m.start(), m.group()))
        at += len(m.group().lower()) + 1
    places = [m[0] for m in marks]

    def place(k: int) -> int:
        a, b, word = marks[max(0, bisect_right(places, k) - 1)]
        return b + min(k - a, len(word))

    return [(place(s), place(e - 1) + 1) for _, _, s, e in found]


def _blocks(benchmark: DataFrame, block_chars: int):
    """The searchable items in blocks; read one by one, so the driver holds one block."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        text = normalise(r["text"])
        if text:
            if block and held + len(text) > block_chars:
                yield block
                block, held = [], 0
            block.append((int(r["item_id"]), text))
            held += len(text)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_item_chars: int = MIN_ITEM_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, budget, start_char, end_char.

    The span is that of the closest passage, in code points of the text as it is.  Null and empty texts hold nothing;
    items that are null, blank or have no id are not searched, and those shorter than ``min_item_chars`` match exactly, on
    word borders.  Items that repeat are found once each.  Rows that repeat, or have no doc_id, are documents of their own.  Empty tables give no rows;
    other columns, whatever their names, are ignored.
    """
    out = None
    small_batches(docs)
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((block, error_rate, min_item_chars))  # at most block_chars, or one item

        def run(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    if found := items.matches(normalise(text)):
                        for (number, d, _, _), (a, b) in zip(found, _spans(text, found)):
                            rows.append((doc, items.items[number][0], d, items.items[number][2], a, b))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = list(zip(*rows)) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "distance", "budget", "start_char", "end_char"])

        part = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int, budget int, start_char long, end_char long")
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_item_chars: int = MIN_ITEM_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns unchanged, whatever their names; a pass a block, without a join.

    Null and empty texts hold nothing and stay, as do rows without a doc_id or that repeat, if they hold no item.  Texts
    are searched whole.  Without items all rows stay; an empty table gives no rows.
    """
    small_batches(docs)
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((block, error_rate, min_item_chars))

        def run(batches, shared=shared):
            items = Items(*shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(normalise(t), True) for t in texts_of(batch)], pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
