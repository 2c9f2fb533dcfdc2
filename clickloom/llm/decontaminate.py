"""Benchmark passages in documents, found through exact pieces and verified by edit distance.

Texts are reduced to lower-cased words (letters with their marks, and digits) with single blanks between. An item of m
characters may differ by k = floor(m * ``RATE``) edits. Cut into k + 1 pieces, at least one piece
stays whole in any such copy (pigeonhole), so one Aho-Corasick automaton over all pieces finds every
place worth looking at; Myers' bit-parallel distance then decides there, against any beginning.

Documents are never shuffled. The items reach the tasks in blocks of bounded size (``BLOCK`` bytes
of text), one pass over the documents a block, however large the benchmark grows.

Defined cases: a null or empty text has no passages; an item without words is found nowhere; items
of under ``WORDS`` words must match exactly; a match that cuts words counts their letters outside it as
edits; of overlapping matches of an item the one with the fewest edits, then the first, is reported; repeated items and rows give repeated
results; a null doc_id or item_id stays null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import work

RATE = 0.08
WORDS = 5
BLOCK = 8 << 20
#: Letters, digits and the marks that belong to letters.
_WORD = re.compile(rf"[\w{work.MARKS}]+")


class Match(NamedTuple):
    item: int  # place in the block
    start: int  # in the reduced text
    end: int
    distance: int


def reduce(text: str | None) -> str:
    return " ".join(_WORD.findall(text or "")).lower()


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges of nearly equal length that cover m characters."""
    return [(m * i // (k + 1), m * (i + 1) // (k + 1)) for i in range(k + 1)]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: str, start: int, stop: int) -> tuple[int, int]:
    """(fewest edits, first end where they are reached) of a pattern against parts of text[start:stop].

    Bit i of the vertical vectors tells how the distance of the pattern's first i + 1 characters
    differs from that of its first i; a part may begin anywhere.
    """
    ones, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, at = m, start
    for i in range(start, stop):
        same = masks.get(text[i], 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(across | plus)
        down = plus & across
        score += bool(up & high) - bool(down & high)
        up <<= 1
        plus = (down << 1 | ~(vertical | up)) & ones
        minus = up & vertical & ones
        if score < best:
            best, at = score, i + 1
    return best, at


def outside(text: str, start: int, end: int) -> int:
    """Letters that the words cut by text[start:end] have outside it."""
    before = start - (text.rfind(" ", 0, start) + 1) if text[start : start + 1] != " " else 0
    after = text.find(" ", end) if text[end - 1 : end] != " " else end
    return before + ((after if after >= 0 else len(text)) - end)


class Finder:
    """Matches of one block of items in reduced texts."""

    def __init__(self, items: list[str], rate: float = RATE):
        import ahocorasick

        self.items, self.automaton = items, ahocorasick.Automaton()
        self.edits, self.masks, self.back = [], [], []
        at: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            m, few = len(item), item.count(" ") + 1 < WORDS
            k = 0 if few else int(m * rate)
            self.edits.append(k)
            self.masks.append(_masks(item))
            self.back.append(_masks(item[::-1]))
            for a, b in pieces(m, k) if m else ():
                at.setdefault(item[a:b], []).append((i, a))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not at
        if at:
            self.automaton.make_automaton()

    def _windows(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(item, begins): places where an item may begin, in runs whose matches may overlap."""
        begins: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, a in places:
                begins.setdefault(item, []).append(end + 1 - size - a)
        for item, found in begins.items():
            found.sort()
            reach, at = len(self.items[item]) + 2 * self.edits[item], 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k] - found[k - 1] > reach:
                    yield item, found[at:k]
                    at = k

    def _exact(self, item: int, begins: list[int], text: str) -> Iterator[Match]:
        """Matches of an item that may not differ."""
        end, m = 0, len(self.items[item])
        for start in begins:
            # The only piece of such an item is the item itself.
            if start >= end and not outside(text, start, start + m):
                end = start + m
                yield Match(item, start, end, 0)

    def _close(self, item: int, low: int, stop: int, text: str) -> Iterator[Match]:
        """Matches inside text[low:stop]: the best, then the best on either side of it, and so on."""
        m, k, parts = len(self.items[item]), self.edits[item], [(low, stop)]
        while parts:
            low, stop = parts.pop()
            if stop - low < m - k:
                continue
            distance, end = best_end(self.masks[item], m, text, low, stop)
            if distance > k:
                continue
            turned = text[max(low, end - m - k) : end][::-1]
            _, length = best_end(self.back[item], m, turned, 0, len(turned))
            start = end - length
            # Letters of cut words on both sides are edits too.
            if distance + outside(text, start, end) <= k:
                yield Match(item, start, end, distance)
                parts += [(low, start), (end, stop)]
            else:
                after = text.find(" ", start, stop)
                parts += [(low, start), (after + 1, stop)] if after >= 0 else [(low, start)]

    def find(self, text: str) -> list[Match]:
        out = []
        for item, begins in self._windows(text) if text and not self.empty else ():
            k = self.edits[item]
            if k:
                found = self._close(item, max(0, begins[0] - k), min(len(text), begins[-1] + len(self.items[item]) + k), text)
            else:
                found = self._exact(item, begins, text)
            out += sorted(found)
        return out

    def any(self, text: str) -> bool:
        return bool(self.find(text))


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of the words of ``text`` that reduced characters start to end stand in."""
    at, first, last = 0, None, 0
    for m in _WORD.finditer(text):
        size = len(m[0].lower())
        if at + size > start and first is None:
            first = m.start()
        if at < end:
            last = m.end()
        at += size + 1
        if at >= end and first is not None:
            break
    return first or 0, last


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple]]:
    """(item_id, reduced text) of all items, in blocks of about ``size`` bytes of text."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(i, reduce(t)) for i, t in part.orderBy("item_id", "text").collect()]


def passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """One row per match: doc_id, item_id, start, end (code points of the text), distance."""
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema, arrow = work.schemas(f"doc_id {doc_kind}, item_id {item_kind}, start long, end long, distance int")
    source = docs.select("doc_id", F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator, shared=shared) -> Iterator:
            finder = Finder([t for _, t in shared.value], rate)
            for batch in batches:
                for at in range(0, batch.num_rows, work.SLICE):
                    part, rows = batch.slice(at, work.SLICE), []
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        rows += [(doc_id, shared.value[m.item][0], *original_span(text, m.start, m.end), m.distance) for m in finder.find(reduce(text))]
                    yield work.record_batch(rows, arrow)

        found = found.unionByName(source.mapInArrow(run, schema))
    return found


def _contains(items: list[tuple], rate: float) -> Callable:
    def make():
        finder = Finder([t for _, t in items], rate)
        return lambda texts: [finder.any(reduce(t)) for t in texts]

    return make


def without_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    for items in blocks(benchmark, block):
        docs = docs.where(~work.text_column(_contains(items, rate), "boolean")(F.col("text").cast("string")))
    return docs
