"""Hard negatives by exact integer products of tiles.

Anchors and candidates are cut into blocks; each block of anchors meets each block of candidates in one task, a tile.  Scores of a tile come
from Strassen's recursive multiplication of int64 matrices: rows, columns and inner length are padded with zeros to what the halvings need, and
seven products of halves take the place of eight until the halves are small.  Its additions are exact: int64 arithmetic is exact modulo
2**64, so whatever an intermediate sum does, a score that fits is right; where a bound on the scores of a tile does not fit, the
same recursion runs over Python's integers.

Two passes go over the tiles.  The first multiplies, label by label, anchors with candidates of their own label, and keeps a heap of the best
positives of each anchor; heaps of tiles merge into one.  These give every anchor its score windows.  The second multiplies all, and keeps
for every window a heap of the best scores of other labels inside it; these merge too.  A merge keeps the best k of two heaps, so the order
of tiles does not matter and no task holds more than a tile and its heaps.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as
padded with zeros; labels are integers; equal scores go to the smaller id; an anchor's own id is no positive of it; repeated rows are
candidates of their own, repeated equal anchors are one; fewer positives or negatives than asked for are all given, none give no
row; scores are longs and saturate; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LONG_MAX, LONG_MIN, stored
from .groups import ship, sorted_groups
from .topk import SCALE, WIDE, _as, _decimals, _matrix, quantized

ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Anchors whose scores are held at once.
ANCHOR_STEP = 512
#: Halving ends at this inner length, or at this many rows or columns.
LEAF = 32
#: Bounds on scores below this allow int64.
FITS = 2.0**62


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and the rows of ``b``, exact in the type of the arrays."""
    (m, k), n = a.shape, len(b)
    halvings = 0
    while min(m, n, k) >> halvings > LEAF:
        halvings += 1
    unit = 1 << halvings
    even = [-(-x // unit) * unit for x in (m, n, k)]
    return strassen(padded(a, even[0], even[2]), padded(b, even[1], even[2]), halvings)[:m, :n]


def padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    """``a`` times the transpose of ``b``; both sides of both can be halved so many times."""
    if not halvings:
        return a @ b.T if a.dtype == object else np.einsum("ik,jk->ij", a, b)
    m, n, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]  # b stands transposed
    c = np.empty((2 * m, 2 * n), a.dtype)
    c11, c12, c21, c22 = c[:m, :n], c[:m, n:], c[m:, :n], c[m:, n:]
    deeper = halvings - 1
    c11[:] = c22[:] = strassen(a11 + a22, b11 + b22, deeper)
    part = strassen(a21 + a22, b11, deeper)
    c21[:] = part
    c22 -= part
    part = strassen(a11, b12 - b22, deeper)
    c12[:] = part
    c22 += part
    part = strassen(a22, b21 - b11, deeper)
    c11 += part
    c21 += part
    part = strassen(a11 + a12, b22, deeper)
    c11 -= part
    c12 += part
    c22 += strassen(a21 - a11, b11 + b12, deeper)
    c11 += strassen(a12 - a22, b21 + b22, deeper)
    return c


class Side:
    """Rows of one side of a tile, sorted by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, at: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x, self.at = ids[order], labels[order], x[order], at[order]

    def of(self, some: np.ndarray) -> Side:
        return Side(self.ids[some], self.labels[some], self.x[some], self.at[some])


def scores(anchors: Side, candidates: Side) -> np.ndarray:
    reach = float(np.abs(anchors.x).sum(axis=1).max(initial=0)) * max(1.0, float(np.abs(candidates.x).max(initial=0)))
    kind = np.int64 if reach < FITS else object
    return product(_as(anchors.x, kind), _as(candidates.x, kind))


def positives(anchors: Side, candidates: Side, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's place, candidate's id, score) of the k best candidates with an anchor's label and another id."""
    for label in np.unique(anchors.labels):
        mine, theirs = anchors.of(anchors.labels == label), candidates.of(candidates.labels == label)
        if not len(theirs.ids):
            continue
        s = scores(mine, theirs)
        other = mine.ids[:, None] != theirs.ids[None, :]
        if s.shape[1] > k:
            low = np.where(other, s, s.min() - 1)
            other &= s >= np.partition(low, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
        row, col = np.nonzero(other)
        found = s[row, col]
        order = np.lexsort((theirs.ids[col], -found, row))
        row, col, found = row[order], col[order], found[order]
        first = np.searchsorted(row, np.arange(len(mine.ids)))
        best = np.arange(len(row)) - first[row] < k
        yield mine.at[row[best]], theirs.ids[col[best]], found[best]


def negatives(anchors: Side, candidates: Side, windows: list, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's place, window's number, candidate's id, score) of the k best candidates of other labels in each window.

    ``windows`` holds, by an anchor's place, (lowest, highest) scores.
    """
    s = scores(anchors, candidates)
    mine = [windows[i] for i in anchors.at]
    if s.dtype == object:
        bound = lambda v: v
    else:
        bound = lambda v: max(-(2**62), min(2**62, v))  # noqa: E731  (no score lies beyond)
    low = np.array([bound(min((a for a, _ in w), default=1)) for w in mine], s.dtype)
    high = np.array([bound(max((b for _, b in w), default=0)) for w in mine], s.dtype)
    inside = (s >= low[:, None]) & (s <= high[:, None]) & (anchors.labels[:, None] != candidates.labels[None, :])
    row, col = np.nonzero(inside.astype(bool))
    found = s[row, col]
    order = np.lexsort((candidates.ids[col], -found, row))
    row, found, ids = row[order], found[order], candidates.ids[col[order]]
    ends = np.searchsorted(row, np.arange(len(mine) + 1))
    places, numbers, picked = [], [], []
    for i, own in enumerate(mine):
        down = -found[ends[i] : ends[i + 1]]  # ascending
        for j, (a, b) in enumerate(own):
            first = int(np.searchsorted(down, bound(-b), "left"))
            last = min(first + k, int(np.searchsorted(down, bound(-a), "right")))
            if first < last:
                picked.append(np.arange(ends[i] + first, ends[i] + last))
                places.append(np.full(last - first, anchors.at[i]))
                numbers.append(np.full(last - first, j))
    if picked:
        at = np.concatenate(picked)
        yield np.concatenate(places), np.concatenate(numbers), ids[at], found[at]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Side, Side]]:
    """(the tile's rows, some anchors, candidates); rows of very large components meet apart."""
    for g in sorted_groups(batches, 2):
        x = _matrix(g.column("v"), max(g.column("width").to_pylist()))
        ids, labels, is_anchor = g.column("vec_id").to_numpy(), g.column("label").to_numpy(), g.column("is_anchor").to_numpy(zero_copy_only=False)
        wide = np.abs(x).max(axis=1, initial=0) > WIDE
        for huge in (False, True):
            there = np.flatnonzero(~is_anchor & (wide == huge))
            if not len(there):
                continue
            candidates = Side(ids[there], labels[there], x[there], there)
            for big in (False, True):
                asked = np.flatnonzero(is_anchor & (wide == big))
                for at in range(0, len(asked), ANCHOR_STEP):
                    here = asked[at : at + ANCHOR_STEP]
                    yield g, Side(ids[here], labels[here], x[here], here), candidates


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, anchors, candidates in _tiles(batches):
            own, key = g.column("vec_id").to_numpy(), g.column("a_key").to_numpy()
            for at, ids, found in positives(anchors, candidates, k):
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(key[at]), pa.array(ids), _decimals(found)], ["anchor_id", "a_key", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, anchors, candidates in _tiles(batches):
            own, key = g.column("vec_id").to_numpy(), g.column("a_key").to_numpy()
            given = {i: g.column("positives")[int(i)].as_py() or [] for i in anchors.at}
            # low * p <= 100 * s <= high * p in whole numbers
            windows = {i: [(-(-low * int(p["positive_score"]) // 100), high * int(p["positive_score"]) // 100) for p in ps] for i, ps in given.items()}
            for at, number, ids, found in negatives(anchors, candidates, windows, k):
                of = [given[i][j] for i, j in zip(at, number, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[at]),
                        pa.array(key[at]),
                        pa.array(number.astype(np.int32)),
                        pa.array([p["positive_id"] for p in of], pa.int64()),
                        pa.array([p["positive_score"] for p in of], pa.decimal128(38, 0)),
                        pa.array(ids),
                        _decimals(found),
                    ],
                    ["anchor_id", "a_key", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    return run


def _long(score: str) -> Column:
    return F.greatest(F.lit(LONG_MIN), F.least(F.lit(LONG_MAX), F.col(score))).cast("long").alias(score)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each of an anchor's best ``n_positives`` rows of its label, the best ``n_negatives`` rows of other labels whose score is between ``low``
    and ``high`` percent of the positive's.  ``is_anchor`` is a condition on vec_id.
    """
    rows = vectors.select("vec_id", "embedding", label.cast("long").alias("label")).filter("label is not null")
    rows = quantized(rows, scale, "label").withColumn("width", F.size("v"))
    rows = stored(rows, "vectors")  # both passes read it; its files also number the rows, so that repeated rows are spread
    anchors = rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "v"]).withColumn("a_key", F.xxhash64("label", "v"))
    n, m = rows.count(), anchors.count()
    many, few = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // ANCHOR_BLOCK))
    here = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(many)).cast("int")
    there = F.pmod(F.xxhash64("vec_id", "a_key"), F.lit(few)).cast("int")
    best = "array<struct<positive_id:bigint,positive_score:decimal(38,0)>>"
    candidates = rows.withColumn("cb", here).select(
        F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("qb"), "cb", F.lit(False).alias("is_anchor"), F.lit(0).cast("long").alias("a_key"), "vec_id", "label", "width", "v", F.lit(None).cast(best).alias("positives")
    )

    def met(asked: DataFrame) -> DataFrame:
        queries = asked.select(there.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("cb"), F.lit(True).alias("is_anchor"), "a_key", "vec_id", "label", "width", "v", "positives")
        return candidates.unionByName(queries).repartition("qb", "cb").sortWithinPartitions("qb", "cb")

    def merged(heaps: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))
        return heaps.withColumn("rank", rank).filter(F.col("rank") <= k)

    found = met(anchors.withColumn("positives", F.lit(None).cast(best))).mapInArrow(_positives(n_positives), "anchor_id long, a_key long, positive_id long, positive_score decimal(38,0)")
    found = merged(found, ["anchor_id", "a_key"], "positive_score", "positive_id", n_positives)
    heap = F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))), lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score")))
    heaps = found.groupBy(F.col("anchor_id").alias("_id"), F.col("a_key").alias("_key")).agg(heap.alias("positives"))
    windows = anchors.join(heaps, (F.col("vec_id") == F.col("_id")) & (F.col("a_key") == F.col("_key")))
    schema = "anchor_id long, a_key long, place int, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)"
    out = met(windows).mapInArrow(_negatives(n_negatives, low, high), schema)
    out = merged(out, ["anchor_id", "a_key", "place"], "negative_score", "negative_id", n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", _long("positive_score"), _long("negative_score"))


ship(__name__)
