"""Language ID by nearest centroid.

A text becomes a vector of hashed character n-grams (1 to 3 letters, lower case, all else a space) with weights
(1 + log tf) * idf, of length 1.  Each language has several centroids, found by spherical k-means over its own texts; a
text gets the language of the nearest centroid by cosine.  It is rejected where its cosine is under the floor of its length class,
which is learned: ``MARGIN`` times the 1 % quantile of the cosines of the fitting texts of that length, or a higher one
with ``BELOW`` texts below it where they are few, so single odd rows do not move it.  Where fewer than ``FEW`` fitting texts are of that length, pieces of that length, one of each longer
fitting text, stand for them.  Texts of a few words lie near any centroid, so unknown ones pass more often the shorter they are.

The classifier is fitted on at most about ``sample`` labelled rows (a documented bound), drawn by hash of the id; the counts
of n-grams of these stay with the executors, a language's in one task, and only document frequencies, centroids and cosines reach the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected; a null doc_id is never fitted on
and not held out; rows without a lang are classified but not fitted on; an empty table, or one without labels, gives ``und``
everywhere; repeated rows are classified row by row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, stored, unit
from .groups import ship

DIMENSIONS = 1 << 14
SAMPLE = 3000
CENTROIDS = 3
#: Lengths in letters that part texts into classes for the rejection.
LENGTHS = (8, 16, 32, 64, 128, 256)
#: The floor of a length class is this quantile of its fitting texts' cosines, or that with BELOW of them below it if higher, times
#: the margin; fewer than FEW do not tell.
LOW, BELOW, MARGIN, FEW = 0.01, 5, 0.5, 40
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed n-grams, their counts, and the number of letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[cp]
    n = int(is_letter.sum())
    if not n:
        return np.empty(0, np.int64), np.empty(0), 0
    x = np.where(is_letter, cp, 32).astype(np.uint64)
    gap = x == 32
    x = np.concatenate(([np.uint64(32)], x[~(gap & np.concatenate(([True], gap[:-1])))], [np.uint64(32)]))
    one = x * np.uint64(0x9E3779B97F4A7C15)
    two = (x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (one[1:] >> np.uint64(7))
    three = (two[:-1] * np.uint64(0x165667B19E3779F9)) ^ (one[2:] >> np.uint64(3))
    code = np.concatenate([g * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 14) for g in (one, two, three)]).astype(np.int64)
    count = np.bincount(code, minlength=DIMENSIONS)
    at = np.flatnonzero(count)
    return at, count[at], n


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # the least cosine by length class


def _vector(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are the mean's nearest row, then always the row farthest from all seeds."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    c = x[seeds].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].sum(axis=0)
                c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, letters, "right")


def _low(cosine: np.ndarray) -> float:
    return MARGIN * float(np.quantile(cosine, max(LOW, min(0.5, BELOW / len(cosine)))))


def floors(letters: np.ndarray, cosine: np.ndarray, piece: np.ndarray | None = None) -> np.ndarray:
    """The least cosine that is not rejected, by length class, from lengths and cosines of fitting texts and of ``piece``s of them."""
    n, size = len(LENGTHS) + 1, length_class(letters)
    piece = np.zeros(len(size), bool) if piece is None else piece
    out: list[float | None] = []
    for c in range(n):
        own = cosine[(size == c) & ~piece]
        own = own if len(own) >= FEW else cosine[size == c]
        out.append(_low(own) if len(own) >= FEW else None)
    if all(f is None for f in out):
        out[-1] = _low(cosine)
    for c in range(n - 2, -1, -1):
        if out[c + 1] is not None:  # a shorter text may be as far as any longer one
            out[c] = out[c + 1] / 2 if out[c] is None else min(out[c], out[c + 1])
    for c in range(1, n):
        if out[c] is None:
            out[c] = out[c - 1]
    return np.array(out)


def piece_of(text: str, length: int) -> str | None:
    """A piece of ``length`` characters of a text of at least four times that length, from a place that the text gives."""
    if len(text) < 4 * length:
        return None
    at = zlib.crc32(text[:256].encode("utf-8", "surrogatepass")) % (len(text) - length)
    return text[at : at + length]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for b in batches:
        rows = []
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows.append((lang, False, *grams(t, letters)))
            # pieces that fall into each class: half as long again as its least length
            rows += [(lang, True, *grams(p, letters)) for n in (2, *LENGTHS) if (p := piece_of(t, 3 * n // 2))]
        rows = [r for r in rows if r[4]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.bool_()),
                pa.array([r[2].astype(np.uint16).tobytes() for r in rows], pa.binary()),
                pa.array([r[3].astype(np.uint32).tobytes() for r in rows], pa.binary()),
                pa.array([r[4] for r in rows], pa.int64()),
            ],
            ["lang", "piece", "at", "count", "letters"],
        )


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Learn from text and lang of the rows that are not held out.

    The sampled texts stay with the executors: the driver gets sums of the tasks, the centroids and three numbers a text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter(~held_out()).filter("doc_id is not null and text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = max(1, sample // len(langs))
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, each / counts[k])])
    chosen = rows.filter(unit(F.xxhash64("doc_id", F.lit(5))) < rate[F.col("lang")])
    grams_of = chosen.select("lang", "text").mapInArrow(_count, "lang string, piece boolean, at binary, count binary, letters long")
    rows = stored(grams_of, "grams")
    texts = rows.filter("not piece")
    df, whole = np.zeros(DIMENSIONS, np.int64), 0
    for r in texts.select("at").mapInArrow(_frequencies, "n long, df binary").toLocalIterator():
        df, whole = df + np.frombuffer(r["df"], np.int64), whole + r["n"]
    if not whole:
        release(rows)
        return None
    idf = np.log((1 + whole) / (1 + df)) + 1
    made = texts.groupBy("lang").applyInArrow(_centroids(idf, centroids), "lang string, centroids binary").collect()
    of = {r["lang"]: np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in made}
    owner = [n for n, lang in enumerate(langs) for _ in of.get(lang, ())]
    table = np.vstack([of[lang] for lang in langs if lang in of])
    near = rows.select("piece", "at", "count", "letters").mapInArrow(_cosines(idf, table), "piece boolean, letters long, cosine float").toArrow()
    low = floors(*(near.column(c).to_numpy() for c in ("letters", "cosine", "piece")))
    release(rows)
    return Model(langs, np.array(owner), table, idf, low)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task there are, and how many hold each gram."""
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for b in batches:
        for at in b.column(0).to_pylist():
            df[np.frombuffer(at, np.uint16)] += 1
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def _centroids(idf: np.ndarray, k: int):
    """The centroids of one language, whose texts are a sample of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("letters", "at", "count", "lang")), strict=True))
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (_, at, count, _) in enumerate(rows):
            at = np.frombuffer(at, np.uint16).astype(np.int64)
            x[i, at] = _vector(at, np.frombuffer(count, np.uint32), idf)
        return pa.table({"lang": pa.array([rows[0][3]], pa.string()), "centroids": pa.array([_cluster(x, k).astype(np.float32).tobytes()], pa.binary())})

    return run


def _cosines(idf: np.ndarray, centroids: np.ndarray):
    """The cosine of each fitting text, or piece of one, to its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(centroids.T)
        for b in batches:
            found = []
            for at, count in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = np.frombuffer(at, np.uint16).astype(np.int64)
                found.append((_vector(at, np.frombuffer(count, np.uint32), idf).astype(np.float32) @ table[at]).max())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(found, pa.float32())], ["piece", "letters", "cosine"])

    return run


class Nearest:
    """A fitted model, ready to classify texts."""

    def __init__(self, model: Model | None):
        self.model, self.letters = model, letter_table()
        self.table = np.ascontiguousarray(model.centroids.T) if model else None

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected."""
        model = self.model
        at, count, n = grams(text, self.letters) if text and model else ((), (), 0)
        if not n:
            return UNKNOWN, 0.0, True
        cosine = _vector(at, count, model.idf).astype(np.float32) @ self.table[at]
        best = int(np.argmax(cosine))
        far = bool(cosine[best] < model.floor[length_class(n)])
        return model.langs[model.owner[best]], float(min(1.0, max(0.0, cosine[best]))), far


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(model)
        for b in batches:
            found = [nearest(t) for t in b.column(2).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine) and rejected of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def _known(model: Model | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(model)
        for b in batches:
            yield b.filter(pa.array([not nearest(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``, all columns, without the rows that are rejected; without a model, only without those that have no letter."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_known(model, docs.columns.index("text")), docs.schema)


ship(__name__)
