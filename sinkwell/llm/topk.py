"""Exact top-k inner product search by aggregation without random access.

Vectors are cut into blocks; each block of queries meets each block of candidates in one task (a stated query set against all
rows, in blocks).  There every dimension is a list of the candidates sorted by value, which a query reads from the top for a
positive component and from the bottom for a negative one; a component of 0 reads no list.  All lists are read to the same
depth, in strides, for a group of queries at a time.  A candidate's sum over the entries that have been read is kept.  Its lower
bound adds the list's last value wherever it has not been met, its upper bound the value at the list's front.  Candidates
whose upper bound is under the k-th best lower bound cannot qualify; once few can, reading stops for all others, and
the final scores of these finalists are resolved from their entries that have not been read.  A query that never comes to this
reads the lists to their ends, where both bounds have met in the score.  There is no other way to a score.  The best k of each
block are merged over the blocks.

How far the lists are read depends on the data: a query near to its answers, or values of very unlike size, stop early;
vectors spread evenly in many dimensions are read almost to the end.  ``top_k(..., reads=True)`` counts the entries.

Components are integers, floor(scale * x), and sums are exact: in floats where these hold every sum, in Python's integers
for the vectors with components beyond 2**20.  Scores are decimal(38, 0); beyond 38 digits they saturate.  Defined cases: rows with a null id, a
null vector, or a null or non-finite component take no part; shorter vectors count as padded with zeros; equal scores go to the
smaller id; repeated candidate rows are candidates of their own, repeated equal queries are one; a query with fewer than k candidates
gets them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .groups import ship, sorted_groups

SCALE = 256.0
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 2048
#: Queries whose bounds are held at once.
QUERY_STEP = 128
#: The lists are read to these shares of their length.
STRIDES = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1.0)
#: Vectors with a component beyond this are compared apart, in exact integers where needed.
WIDE = 2.0**20
MOST = 10**38 - 1


def quantized(vectors: DataFrame, scale: float = SCALE, *more: str) -> DataFrame:
    """vec_id, the columns ``more`` and the vector of integers (as doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", *more, "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)

    def whole(v: Column) -> Column:
        y = v.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are integers

    return rows.select("vec_id", *more, F.transform(x, whole).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = flat.offsets.to_numpy()
    values = flat.values.to_numpy(zero_copy_only=False)
    if width and len(ends) > 1 and (np.diff(ends) == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(ends) - 1, width))
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        out[i, : b - a] = values[a:b]
    return out


def _as(a: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in another type; as objects they are Python's integers."""
    if kind is not object:
        return a.astype(kind)
    out = np.empty(a.size, object)
    out[:] = [int(v) for v in a.ravel()]
    return out.reshape(a.shape)


class Lists:
    """The sorted lists of a block of candidates, one for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        by = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, by, 0)
        self.place = np.empty(by.shape, np.int64)  # where a candidate stands in a list, from the bottom
        np.put_along_axis(self.place, by, np.arange(len(ids))[:, None], 0)

    def kind(self, q: np.ndarray) -> type:
        """The fastest type in which every sum is exact."""
        reach = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(self.x).max(initial=0))
        return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(number of the query, ids, scores, entries read) of the k best candidates whose id is not its own; ties to the smaller id."""
        n = len(self.ids)
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        kind = self.kind(queries)
        x, queries = _as(self.x, kind), _as(queries, kind)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        n_lists = (queries != 0).sum(axis=1)
        seen = _as(np.zeros((len(queries), n), np.int8), kind)
        open_, depth = np.arange(len(queries)), 0

        def answer(i: int, among: np.ndarray, score: np.ndarray, read: int):
            top = np.lexsort((among, -score))[:k]
            return int(i), self.ids[among[top]], score[top], int(read)

        for share in STRIDES:
            before, depth = depth, max(depth, int(np.ceil(n * share)))
            if depth == before or not len(open_):
                continue
            above, below = self.place >= n - depth, self.place < depth  # met from the top, from the bottom
            entries = np.where(above & (self.place < n - before), x, 0), np.where(below & (self.place >= before), x, 0)
            missing = _as(~above, kind), _as(~below, kind)
            front = _as(self.sorted[n - depth], kind), _as(self.sorted[depth - 1], kind)
            end = _as(self.sorted[0], kind), _as(self.sorted[-1], kind)
            still = []
            for at in range(0, len(open_), QUERY_STEP):
                some = open_[at : at + QUERY_STEP]
                u, d = up[some], down[some]
                seen[some] += u @ entries[0].T + d @ entries[1].T
                if depth == n:  # the bounds have met
                    for i in some:
                        mine = np.concatenate([np.arange(first[i]), np.arange(last[i], n)])
                        line = seen[i][mine]
                        if len(mine) > 4 * k:
                            near = line >= np.partition(line, len(mine) - k)[len(mine) - k]
                            mine, line = mine[near], line[near]
                        yield answer(i, mine, line, n * n_lists[i])
                    continue
                high = seen[some] + (u * front[0]) @ missing[0].T + (d * front[1]) @ missing[1].T
                low = seen[some] + (u * end[0]) @ missing[0].T + (d * end[1]) @ missing[1].T
                least = low.min() - 1
                for row, i in enumerate(some):
                    low[row, first[i] : last[i]] = least
                if n <= k + 1:
                    still.append(some)
                    continue
                bar = np.partition(low, n - k, axis=1)[:, n - k]
                alive = high >= bar[:, None]
                for row, i in enumerate(some):
                    alive[row, first[i] : last[i]] = False
                few = alive.sum(axis=1) <= max(4 * k, n // 16)
                for row in np.flatnonzero(few):
                    i, among = some[row], np.flatnonzero(alive[row])
                    rest = np.where(queries[i] > 0, ~above[among], ~below[among]) & (queries[i] != 0)
                    score = seen[i][among] + np.where(rest, x[among], 0) @ queries[i]
                    yield answer(i, among, score, depth * n_lists[i] + rest.sum())
                still.append(some[~few])
            open_ = np.concatenate(still) if still else open_[:0]


def _search(k: int):
    names = ["q_key", "query_id", "vec_id", "score", "read"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 2):
            x, ids, keys = _matrix(g.column("v"), max(g.column("width").to_pylist())), g.column("vec_id").to_numpy(), g.column("q_key").to_numpy()
            query = g.column("is_query").to_numpy(zero_copy_only=False)
            wide = np.abs(x).max(axis=1, initial=0) > WIDE
            for with_wide in (False, True):
                mine = ~query & (wide == with_wide)
                if not mine.any():
                    continue
                lists = Lists(ids[mine], x[mine])
                for asked in (query & ~wide, query & wide):
                    own, key = ids[asked], keys[asked]
                    out = [(np.full(len(found), key[i]), np.full(len(found), own[i]), found, _decimals(score), np.full(len(found), read)) for i, found, score, read in lists.best(own, x[asked], k)]
                    if out:
                        numbers = [pa.array(np.concatenate(c), pa.int64()) for c in list(zip(*out, strict=True))[:3]]
                        scores = pa.concat_arrays([o[3] for o in out])
                        yield pa.RecordBatch.from_arrays([*numbers, scores, pa.array(np.concatenate([o[4] for o in out]), pa.int64())], names)

    return run


def _decimals(score: np.ndarray) -> pa.Array:
    if score.dtype != object:
        return pa.array(np.rint(score).astype(np.int64)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(max(-MOST, min(MOST, int(s)))) for s in score], pa.decimal128(38, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = SCALE, reads: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for every row where ``is_query`` holds.

    ``reads`` adds ``entries_read``, the list entries read for the query in all blocks of candidates, and ``entries``, all there are.
    """
    rows = quantized(vectors, scale).withColumns({"q_key": F.xxhash64("vec_id", "v"), "width": F.size("v")})
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "v"])
    n, m = rows.count(), asked.count()
    many, few = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    here = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(many)).cast("int")
    there = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(few)).cast("int")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("qb"), here.alias("cb"), F.lit(False).alias("is_query"), "q_key", "vec_id", "width", "v")
    queries = asked.select(there.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("cb"), F.lit(True).alias("is_query"), "q_key", "vec_id", "width", "v")
    met = candidates.unionByName(queries).repartition("qb", "cb").sortWithinPartitions("qb", "cb")
    found = met.mapInArrow(_search(k), "q_key long, query_id long, vec_id long, score decimal(38,0), read long")
    one = W.partitionBy("query_id", "q_key")
    if reads:  # a block reports its reads on each of its rows: once is enough
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(many))
        once = F.row_number().over(W.partitionBy("query_id", "q_key", block).orderBy("vec_id")) == 1
        total = F.sum(F.when(F.col("once"), F.col("read"))).over(one)
        found = found.withColumn("once", once).withColumn("entries_read", total).crossJoin(rows.agg(F.sum("width").alias("entries")))
    ranked = found.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["entries_read", "entries"] if reads else []))


ship(__name__)
