"""Benchmark decontamination by pigeonhole edit matching.

A test item of n code points (lower case, white space runs as one space) may be met with up to k = floor(``budget`` * n) edits.
It is split into k + 1 pieces; k edits leave one piece whole, so every match holds an exact piece at its place.  One automaton
over all pieces finds the exact hits in a pass over each whole document; around each hit, Myers' bit-parallel distance verifies
the item against the document.

Test items are the stated query set: they stream through the driver once and are cut into blocks that end with the item that
brings them to ``BLOCK_CHARS`` code points, one pass over the documents for each block.  So a task holds one block, whatever the size
of the benchmark; the plan holds all blocks, and its passes grow with the benchmark.

Defined cases: null and blank items and texts match nothing; an item of fewer than ``min_chars`` code points counts only where it is the
whole document; repeated documents and items are reported row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .groups import ship

BUDGET = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def alphabet_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and the end of the first such substring."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float, min_chars: int):
        self.items = [(i, t, int(len(t) * budget)) for i, t in items if len(t) >= min_chars]
        self.whole: dict[str, list[int]] = {}
        for i, t in items:
            if 0 < len(t) < min_chars:
                self.whole.setdefault(t, []).append(i)
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, p in pieces(t, k):
                found.setdefault(p, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for p, places in found.items():
            self.automaton.add_word(p, (len(p), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, end of the match in the normal form of the text)."""
        t = normal(text)
        out = [(i, 0, len(t)) for i in self.whole.get(t, ())]
        if not self.items or not t:
            return out
        starts: dict[int, set[int]] = {}
        for e, (length, places) in self.automaton.iter(t):
            for n, offset in places:
                starts.setdefault(n, set()).add(e + 1 - length - offset)
        for n, at in starts.items():
            item, pattern, k = self.items[n]
            m = len(pattern)
            exact = next((s for s in sorted(at) if s >= 0 and t.startswith(pattern, s)), None)
            if exact is not None:
                out.append((item, 0, exact + m))
                continue
            if n not in self.masks:
                self.masks[n] = alphabet_masks(pattern)
            best = (k + 1, 0)
            low = high = None
            for s in [*sorted(at), None]:
                if low is not None and (s is None or s - k > high):
                    distance, end = nearest(self.masks[n], m, t[low:high])
                    best = min(best, (distance, low + end))
                    low = None
                if s is not None:
                    low, high = max(0, s - k) if low is None else low, s + m + k
            if best[0] <= k:
                out.append((item, *best))
        return out


def _search(items: list[tuple[int, str]], budget: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, budget, min_chars)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for hit in matcher.find(text)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "match_end"])

    return run


def _clean(items: list[tuple[int, str]], budget: float, min_chars: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, budget, min_chars)
        for b in batches:
            yield b.filter(pa.array([not (t and matcher.find(t)) for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in normal form, in blocks of less than ``BLOCK_CHARS`` code points and one item."""
    held, size, none = [], 0, True
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        held.append((r.item_id, normal(r.text)))
        size += len(held[-1][1])
        if size >= BLOCK_CHARS:
            yield held
            held, size, none = [], 0, False
    if held or none:
        yield held


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item; nothing is shuffled."""
    small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")
    for held in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(held, budget, min_chars, at), schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, item_id, distance and match_end of every document that holds an item within its error budget."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, distance long, match_end long"
    return reduce(DataFrame.union, [texts.mapInArrow(_search(held, budget, min_chars), schema) for held in item_blocks(benchmark)])


ship(__name__)
