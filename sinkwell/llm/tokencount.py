"""Edit-aware token counts.

A byte-level tokenizer splits a text into pre-tokens by a pattern that reads from left to right, and encodes each by itself.  So
a document's count is a sum over its pre-tokens, kept in a segment tree.  An edit (start, end, replacement) is counted by splitting anew
from two pre-tokens before its start until a new boundary meets an old one after its end; only these pre-tokens are
encoded, their sum goes to the first leaf of the region, and the sums above it are updated.  Edits come with the rows, or are
the matches of a pattern that is to be blotted out, found in one pass over the text.

Counts of pre-tokens are remembered within a task, up to ``REMEMBERED`` of them.  The vocabulary is a public file of bounded size
that is read by the driver and sent with the code.

Defined cases: a null or empty text has 0 tokens; strings of special tokens in a text are ordinary text; edits must be sorted
and must not overlap (else an error), null edits are none; rows are counted one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .groups import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabularies split text.  A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000
#: Personal data: addresses of mail and machines, long numbers.  Possessive, so that a text is scanned in one pass.
PERSONAL = r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]++|\d{1,3}+(?:\.\d{1,3}+){3}|\d{7,}+"
REDACTED = "[redacted]"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class Counter:
    """Tokens of a pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> np.ndarray:
        known, encode = self.known, self.encoding.encode_ordinary
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(encode(p))
                if len(p) < 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            out.append(n)
        return np.array(out, np.int64)


def build(leaves: np.ndarray) -> list[np.ndarray]:
    """Levels of a segment tree, leaves first."""
    levels = [leaves if len(leaves) else np.zeros(1, np.int64)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append(np.add.reduceat(low, np.arange(0, len(low), 2)))
    return levels


class Document:
    """The pre-token tree of one text."""

    def __init__(self, text: str, counter: Counter, pattern):
        self.text, self.counter, self.pattern = text, counter, pattern
        found = pattern.findall(text)
        self.ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.levels = build(counter(found))
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.levels[-1][0])

    def put(self, first: int, last: int, n: int) -> None:
        """Leaves first..last - 1 become one region of n tokens."""
        self.levels[0][first:last] = 0
        self.levels[0][first] = n
        low, high = first, max(first, last - 1)
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            low, high = low >> 1, high >> 1
            at = np.arange(low, high + 1)
            right = np.minimum(2 * at + 1, len(below) - 1)
            above[low : high + 1] = below[2 * at] + np.where(right > 2 * at, below[right], 0)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted edits that do not overlap; the tree then holds the count of the edited text."""
        parts, at, shifts = [], 0, []
        for s, e, new in edits:
            if not at <= s <= e <= len(self.text):
                raise ValueError("edits must be sorted, apart and inside the text")
            parts += [self.text[at:s], new]
            shifts.append(len(new) - (e - s))
            at = e
        text = "".join([*parts, self.text[at:]])
        i, shift = 0, 0
        while i < len(edits):
            first = max(0, int(np.searchsorted(self.ends, edits[i][0])) - 2)
            begin = int(self.ends[first - 1]) if first else 0
            start, until, last = begin + shift, -1, len(self.ends)
            pieces: list[str] = []
            while i < len(edits) and until < 0:
                shift += shifts[i]
                i += 1
                # split on until a boundary meets an old one past this edit, or the next edit comes near
                near = edits[i][0] if i < len(edits) else len(self.text) + 1
                for m in self.pattern.finditer(text, start):
                    pieces.append(m.group())
                    start = m.end()
                    old = start - shift
                    if old >= edits[i - 1][1]:
                        j = int(np.searchsorted(self.ends, old))
                        if j < len(self.ends) and self.ends[j] == old:
                            if j + 3 < len(self.ends) and self.ends[j + 3] >= near or j + 3 >= len(self.ends) and near <= len(self.text):
                                break
                            until, last = start, j + 1
                            break
                        if old >= near:
                            break
                else:
                    if i >= len(edits):
                        until = start
            n = int(self.counter(pieces).sum())
            self.encoded += len(pieces)
            self.put(first, max(last, first + 1), n)
        self.text = text


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def matches(text: str, pattern, replacement: str = REDACTED) -> list[tuple[int, int, str]]:
    """Edits that blot out the matches of a pattern, from left to right."""
    return [(*m.span(), replacement) for m in pattern.finditer(text)]


def _run(ranks: dict[bytes, int], redact: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pattern = Counter(ranks), regex.compile(PATTERN)
        found = regex.compile(redact, regex.ASCII) if redact else None
        for b in batches:
            out = []
            for text, given in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = Document(text or "", counter, pattern)
                before, pre = doc.total, len(doc.ends)
                edits = matches(doc.text, found) if found else [(e["start"], e["end"], e["replacement"] or "") for e in given or ()]
                if edits:
                    doc.edit(edits)
                out.append((before, pre, len(edits), doc.total, doc.encoded))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return run


def count_tokens(docs: DataFrame, edits: Column | None = None, redact: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited and n_reencoded (pre-tokens encoded for the edits).

    The edits are ``edits`` (of type ``EDITS``) or blot out what matches ``redact``.
    """
    if edits is not None and redact:
        raise ValueError("either edits or a pattern")
    small_batches(docs.sparkSession)
    given = edits if edits is not None else F.lit(None).cast(EDITS)
    rows = docs.select("doc_id", "text", given.alias("edits"))
    schema = "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_reencoded long"
    return rows.mapInArrow(_run(read_ranks(vocabulary), redact), schema)


ship(__name__)
