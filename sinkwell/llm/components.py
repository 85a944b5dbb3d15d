"""Connected components as a DataFrame loop: alternate large-star and small-star steps.

Every step is an aggregation and a join with what it gave.  A vertex with very many neighbours is pre-aggregated; the
aggregate is written before the join, so that both sides are plain exchanges and a hot vertex can be split.  Each round is
written to the shared folder, which cuts the lineage, and what it replaces is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    near = e.select(F.col("p").alias("u"), F.col("c").alias("v")).union(e.select("c", "p"))
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return near.join(least, "u").filter("v > u").select(F.col("m").alias("p"), F.col("v").alias("c")), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = stored(e.groupBy("c").agg(F.min("p").alias("m")), "least")
    moved = e.join(least, "c").filter("p <> m").select(F.col("m").alias("p"), F.col("p").alias("c"))
    return moved.union(least.select(F.col("m").alias("p"), "c")), least


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("p", "c").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b); returns (id, component) for every vertex but the least of each component, which is its name."""
    e = edges.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("c")).filter("p <> c").distinct()
    e = stored(e, "edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        for star in (_large_star, _small_star):
            moved, least = star(e)
            before, e = e, stored(moved.distinct(), "edges")
            release(before, least)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("c").alias("id"), F.col("p").alias("component"))
