"""Edges laid out by their start, so that a search shuffles them once and not at every level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import release, stored, stored_by

#: Edges of one start in one piece.
CHUNK = 100_000


class Layout:
    """GRF-22: the edges (``src`` and any other columns) in buckets of their start.

    Repeated rows are one; they are dropped where the edges are dealt, so the edges are exchanged once.  A start with more than ``CHUNK`` edges is
    dealt into pieces, by hash of the row, so that no task of a later join holds more than about a piece of it; ``step`` repeats a front row for each
    piece.  Only the front is exchanged at a step.  ``starts`` has the rows of ``edges``, repeated ones included, where they are cheaper to count alone.
    """

    def __init__(self, edges: DataFrame, chunk: int = CHUNK, starts: DataFrame | None = None):
        self.chunk, self.columns = chunk, edges.columns
        rows = edges.filter("src is not null")
        degrees = (rows if starts is None else starts.filter("src is not null")).groupBy("src").agg(F.count("*").alias("_n"))
        hot = stored(degrees.filter(F.col("_n") > chunk).select(F.col("src").alias("_hot"), F.ceil(F.col("_n") / chunk).cast("int").alias("_pieces")), "hot")
        self.split = not hot.isEmpty()
        if self.split:
            rows = rows.join(hot, F.col("src") == F.col("_hot"), "left")
            rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*edges.columns), F.coalesce("_pieces", F.lit(1)))).drop("_hot", "_pieces")
            self.hot = hot
        else:
            release(hot)
        self.edges = stored_by(rows, ["src", "_piece"] if self.split else ["src"], "edges", distinct=True)

    def step(self, front: DataFrame, at: str, how: str = "inner", crowded: bool = False) -> DataFrame:
        """``front`` joined with the edges that start at its column ``at``; with ``how="left"`` rows without an edge stay.

        With ``crowded`` many rows of the front, which is stored, may stand at one start.  A bucket cannot be divided, so the edges of starts with more
        than ``chunk`` rows are read once for all of them; these rows meet them in a join that is broadcast, or whose exchanges can be split.
        """
        if not crowded:
            return self._met(front, at, how)
        busy = front.groupBy(F.col(at).alias("_busy")).agg(F.count("*").alias("_n")).filter(F.col("_n") > self.chunk)
        busy = stored(busy.select("_busy"), "busy")
        if busy.isEmpty():
            release(busy)
            return self._met(front, at, how)
        near = stored(self._met(busy, "_busy", "inner").select(*self.columns), "near")
        columns = [*front.columns, *self.columns]
        alone = self._met(front.join(busy, F.col(at) == F.col("_busy"), "left_anti"), at, how).select(*columns)
        return alone.union(front.join(busy, F.col(at) == F.col("_busy"), "left_semi").join(near, F.col(at) == F.col("src"), how).select(*columns))

    def _met(self, front: DataFrame, at: str, how: str) -> DataFrame:
        if not self.split:
            return front.join(self.edges, F.col(at) == F.col("src"), how)
        dealt = front.join(self.hot, F.col(at) == F.col("_hot"), "left")
        dealt = dealt.withColumn("_at_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        met = dealt.join(self.edges, (F.col(at) == F.col("src")) & (F.col("_at_piece") == F.col("_piece")), how)
        if how == "left":  # a piece may be empty
            met = met.filter(F.col("src").isNotNull() | F.col("_hot").isNull())
        return met.drop("_hot", "_pieces", "_at_piece", "_piece")

    def release(self) -> None:
        release(self.edges)
        if self.split:
            release(self.hot)
