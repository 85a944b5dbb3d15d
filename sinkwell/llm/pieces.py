"""SentencePiece encoding and decoding with a BPE model.

Every prefix of a text has one encoding, so it has one last token.  The prefix table holds that token for every prefix, from left to right:
an automaton over the vocabulary names the pieces that end at a place, and the right one is the piece that may follow the last token of the
prefix before it.  The ids are then recovered from the end of the text backwards.  The table is linear in the text, whatever it holds.

Two tokens may stand together if merging their joined text ends in just these two.  Merging takes the pair whose joint piece scores best, the
leftmost of equal ones.  Until a merge crosses the border, each side runs through the same states as it does alone, so a
pair is tested by walking the two histories (`History`) side by side and asking whether the pair at the border ever comes first.
A token that does not come out of merging its own text never is a last token.  Characters outside of the vocabulary stand alone and become byte tokens.

No merge crosses a border between two characters that no piece holds side by side, which is read off the vocabulary: a space after another
character, a letter before a comma.  So a text is a chain of independent parts, each with a table of its own; coarser segments, at spaces and between
letters and other characters, are cut first, by a pattern.  The ids of short segments and parts are remembered within a task, up to twice ``REMEMBERED`` that were used lately, and so are answers for pairs.

The model file is public and of bounded size; the driver reads it and sends it with the code.  It must be a BPE model without a character map, user
symbols, or removal of spaces (else an error).

Defined cases: a null or empty text has no tokens but the end id; names of control tokens in a text are ordinary text; rows are encoded one by
one; null ids decode to an empty text, null or unknown ids are an error; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import small_batches
from .groups import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: kinds of pieces, the sign for a space, the surface of the unknown token.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
REPLACEMENT = "�"
REMEMBERED, LONGEST = 200_000, 40
PAIRS = 1_000_000
#: Texts beyond this are segmented piece by piece, not in a list.
LONG_TEXT = 1_000_000


# ---------------------------------------------------------------- the model file


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            at += size
            yield tag >> 3, data[at - size : at]


@dataclass
class Vocabulary:
    """Pieces by id with scores and kinds, the id of the end token, and whether texts begin with a space."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    end: int
    prefix: bool

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


def read_model(path: str) -> Vocabulary:
    pieces, scores, kinds = [], [], []
    trainer: dict = {}
    normalizer: dict = {}
    for number, value in fields(Path(path).read_bytes()):
        if number == 1:
            own = dict(fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    plain = trainer.get(3) == BPE and not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24, 0)
    if not plain or {USER, UNUSED} & set(kinds):
        raise ValueError("only BPE models that change nothing in a text but its spaces")
    if trainer.get(35, 0) and sum(k == BYTE for k in kinds) != 256:
        raise ValueError("byte pieces are missing")
    end = trainer.get(42, 2)
    return Vocabulary(pieces, scores, kinds, end, bool(normalizer.get(3, 1)))


# ---------------------------------------------------------------- encoding


class History:
    """The states through which merging takes a token's text: before each merge the first and last symbol, and the merge's score."""

    __slots__ = ("scores", "first", "last", "whole")

    def __init__(self, text: str, score: dict[str, float]):
        symbols = list(text)
        self.scores, self.first, self.last = [], [symbols[0]], [symbols[-1]]
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.scores.append(best)
            self.first.append(symbols[0])
            self.last.append(symbols[-1])
        self.whole = len(symbols) == 1


class Memory:
    """Results for short texts: ``REMEMBERED`` new ones and as many older ones, of which those that are asked for become new."""

    def __init__(self):
        self.new: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def get(self, text: str) -> list[int] | None:
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is not None:
                self.put(text, found)
        return found

    def put(self, text: str, ids: list[int]) -> None:
        if len(text) <= LONGEST:
            if len(self.new) >= REMEMBERED:
                self.new, self.old = {}, self.new
            self.new[text] = ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.score = {p: v.scores[i] for p, i in v.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in v.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.histories: dict[str, History] = {}
        self.follow: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.words, self.parts = Memory(), Memory()
        self.joined = {p[i : i + 2] for p in v.ids for i in range(len(p) - 1)}
        self.segments = self.pattern()

    def pattern(self) -> re.Pattern:
        """Segments of a text: runs of letters or of other characters, with the spaces before them, as far as no piece goes across."""
        if any(two[1] == SPACE and two[0] != SPACE for two in self.joined):
            return re.compile(r"(?s:.+)")
        inside = sorted(set().union(*self.joined) - {SPACE})
        apart = all(two[0].isalpha() == two[1].isalpha() for two in self.joined if SPACE not in two)
        runs = [[c for c in inside if c.isalpha()], [c for c in inside if not c.isalpha()]] if apart else [inside]
        runs = ["[" + "".join(map(re.escape, r)) + "]" for r in runs if r]
        after = "|".join(f"{r}+" for r in runs) or "(?!)"
        return re.compile(f"{SPACE}+(?:{after})?|{after}|(?s:.)")

    def history(self, token: str) -> History:
        h = self.histories.get(token)
        if h is None:
            h = self.histories[token] = History(token, self.score)
        return h

    def following(self, token: str) -> dict[str, bool]:
        """The answers of ``compatible`` so far for what may follow a token; an empty one is the beginning."""
        known = self.follow.get(token)
        if known is None:
            known = self.follow[token] = {}
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text ends in these two tokens, or in the right one where the left one is empty."""
        if self.pairs >= PAIRS:
            self.follow, self.pairs = {}, 0
        self.pairs += 1
        fits = self.stand_together(self.history(left), self.history(right)) if left else self.history(right).whole
        self.following(left)[right] = fits
        return fits

    def stand_together(self, a: History, b: History) -> bool:
        if not (a.whole and b.whole):
            return False
        i = j = 0
        while True:
            across = self.score.get(a.last[i] + b.first[j])
            own = a.scores[i] if i < len(a.scores) else None
            other = b.scores[j] if j < len(b.scores) else None
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is not None and (other is None or own >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                return True

    def table(self, text: str) -> list[str | None]:
        """The last token of every prefix of a segment; None stands for a character outside of the vocabulary."""
        last: list[str | None] = [None] * (len(text) + 1)
        after: list[dict[str, bool] | None] = [self.following(""), *last[1:]]
        for at, piece in self.automaton.iter(text):
            end = at + 1
            if last[end] is None:
                start = end - len(piece)
                known = after[start]
                if known is None:
                    known = after[start] = self.following(last[start] or text[start - 1])
                fits = known.get(piece)
                if fits is None:
                    fits = self.compatible((last[start] or text[start - 1]) if start else "", piece)
                if fits:
                    last[end] = piece
        return last

    def part(self, text: str) -> list[int]:
        """The ids of an independent part, from its table backwards."""
        last, at, out = self.table(text), len(text), []
        v = self.vocabulary
        while at:
            piece = last[at]
            if piece is not None:
                out.append(v.ids[piece])
                at -= len(piece)
            else:
                at -= 1
                out.extend([v.bytes[b] for b in reversed(text[at].encode())] if v.bytes else [v.unknown])
        out.reverse()
        return out

    def segment(self, text: str) -> list[int]:
        """The ids of a segment: of its parts between characters that no piece holds side by side."""
        joined, start, out = self.joined, 0, []
        for end in range(1, len(text) + 1):
            if text[end - 1 : end + 1] not in joined:
                part = text[start:end]
                ids = self.parts.get(part)
                if ids is None:
                    ids = self.part(part)
                    self.parts.put(part, ids)
                out += ids
                start = end
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        whole = (SPACE if self.vocabulary.prefix else "") + text.replace(" ", SPACE)
        words, out = self.words, []
        for s in self.segments.findall(whole) if len(whole) < LONG_TEXT else map(re.Match.group, self.segments.finditer(whole)):
            ids = words.new.get(s)
            if ids is None:
                ids = words.get(s)
                if ids is None:
                    ids = self.segment(s)
                    words.put(s, ids)
            out += ids
        return out


# ---------------------------------------------------------------- decoding


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.prefix = v.prefix
        surface = {NORMAL: lambda p: p.replace(SPACE, " "), CONTROL: lambda p: "", UNKNOWN: lambda p: UNKNOWN_SURFACE, BYTE: lambda p: None}
        self.surface = [surface[k](p) for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.byte = {i: b for b, i in v.bytes.items()}
        for i, b in self.byte.items():
            if b < 128:  # never part of a longer character
                self.surface[i] = chr(b)
        self.opens = [k == NORMAL and p.startswith(SPACE) for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.silent = [k == CONTROL for k in v.kinds]

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        if ids and not 0 <= min(ids) <= max(ids) < len(surface):
            raise ValueError("an id outside of the vocabulary")
        parts = [surface[i] for i in ids]
        if None in parts:
            parts = []
            for raw, run in groupby(ids, lambda i: surface[i] is None):
                parts += [text_of(bytes(self.byte[i] for i in run))] if raw else [surface[i] for i in run]
        text = "".join(parts)
        first = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if self.prefix and first is not None and self.opens[first] else text


def text_of(data: bytes) -> str:
    """The text of a run of byte tokens; every byte that begins no character becomes a replacement character."""
    codecs.register_error("bytewise", lambda e: (REPLACEMENT, e.start + 1))
    return data.decode("utf-8", "bytewise")


# ---------------------------------------------------------------- on Spark


def _encode(vocabulary: Vocabulary, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(vocabulary), [vocabulary.end] if end else []
        for b in batches:
            ids = [encoder.encode(t or "") + tail for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for b in batches:
            flat, at, texts = b.column(1).flatten(), 0, []
            if flat.null_count:
                raise ValueError("a null among the ids")
            flat = flat.to_numpy().tolist()
            for n in b.column(1).value_lengths().fill_null(0).to_pylist():
                texts.append(decoder.decode(flat[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str = MODEL, end: bool = True) -> DataFrame:
    """doc_id and ids of every whole text, with an end id if asked for."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(_encode(read_model(model), end), schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and the decoded text."""
    small_batches(rows.sparkSession)
    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(_decode(read_model(model)), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


ship(__name__)
