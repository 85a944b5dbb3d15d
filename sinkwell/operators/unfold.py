"""Unfolding of a use graph into what each root renders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import stored
from .layout import Layout

#: Components that a root may queue before it stops to expand.  The bound of the reported contract.
MOST_QUEUED = 5000


def unfold(uses: DataFrame, roots: DataFrame, most: int = MOST_QUEUED) -> DataFrame:
    """GRF-11: root, parent, id, pos, depth, recursive, first and truncated, one row for each use that is met.

    ``uses`` has src, dst and pos (their order in the source, at most one row for each pair and pos); ``roots`` has an id.  A component is expanded once
    for each root, in the order in which it is queued: level by level, within a level by the places of the parents, then by pos.  The use that
    queues it is its ``first`` and gives it its ancestors.  A use of the component itself or of one of its ancestors is ``recursive`` and not queued.
    A component is expanded only while at most ``most`` are queued; a root with components that were not is ``truncated``.  The root has a row of its own
    without a parent.  Ancestors are kept as an array, so a level is one join.
    """
    ways = Layout(uses.select("src", "dst", "pos").filter("dst is not null"))
    start = roots.select(F.col("id").alias("root")).filter("root is not null").distinct()
    front = start.select("root", F.col("root").alias("id"), F.lit(1).cast("long").alias("place"), F.array().cast("array<string>").alias("ancestors"))
    none = F.lit(None).cast("string")
    met = [start.select("root", none.alias("parent"), F.col("root").alias("id"), F.lit(None).cast("long").alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("recursive"), F.lit(True).alias("first"))]
    cut, queued, depth = [], [front.select("root", "id")], 0
    while True:
        depth += 1
        step = ways.step(front, "id").select("root", F.col("id").alias("parent"), "place", "ancestors", F.col("dst").alias("id"), F.col("pos").cast("long").alias("pos"))
        recursive = (F.col("id") == F.col("parent")) | F.array_contains("ancestors", F.col("id"))
        step = stored(step.withColumn("recursive", recursive), "uses")
        known = stored(reduce(DataFrame.union, queued), "queued") if len(queued) > 1 else queued[0]
        queued = [known]
        fresh = step.filter("not recursive").groupBy("root", "id").agg(F.min(F.struct("place", "pos", "parent", "ancestors")).alias("by"))
        fresh = fresh.join(known.select(F.col("root").alias("_root"), F.col("id").alias("_id")), (F.col("root") == F.col("_root")) & (F.col("id") == F.col("_id")), "left_anti")
        fresh = stored(fresh.select("root", "id", "by.*"), "fresh")
        # a component is expanded while at most ``most`` are queued: by the levels before, and by those before it on its level
        size = known.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_queued"))
        given = fresh.groupBy("root", "place").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy("root").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        level = front.select("root", "place").join(given, ["root", "place"], "left").withColumn("_before", before)
        level = level.join(size, F.col("root") == F.col("_root")).select("root", "place", "_queued", (F.col("_queued") + F.col("_before") <= most).alias("expanded"))
        level = stored(level, "level")
        cut.append(level.filter("not expanded").select("root"))
        going = level.filter("expanded").select("root", "place")
        place = F.row_number().over(W.partitionBy("root").orderBy("_by", "pos", "id")) + F.col("_queued")
        new = fresh.withColumnRenamed("place", "_by").join(level.filter("expanded").select(F.col("root").alias("_root"), F.col("place").alias("_place"), "_queued"), (F.col("root") == F.col("_root")) & (F.col("_by") == F.col("_place")))
        front = stored(new.select("root", "id", place.alias("place"), F.array_append("ancestors", F.col("parent")).alias("ancestors"), F.col("parent"), "pos"), "front")
        firsts = front.select(F.col("root").alias("_r"), F.col("id").alias("_i"), F.col("parent").alias("_p"), F.col("pos").alias("_at"))
        same = (F.col("root") == F.col("_r")) & (F.col("id") == F.col("_i")) & (F.col("parent") == F.col("_p")) & F.col("pos").eqNullSafe(F.col("_at"))
        seen = step.join(going, ["root", "place"]).join(firsts, same, "left")
        met.append(seen.select("root", "parent", "id", "pos", F.lit(depth).alias("depth"), "recursive", (F.col("_r").isNotNull() & ~F.col("recursive")).alias("first")))
        if front.isEmpty():
            break
        queued.append(front.select("root", "id"))
        front = front.select("root", "id", "place", "ancestors")
    over = reduce(DataFrame.union, cut).distinct().select(F.col("root").alias("_root"))
    out = reduce(DataFrame.union, met)
    return out.join(over, F.col("root") == F.col("_root"), "left").withColumn("truncated", F.col("_root").isNotNull()).drop("_root")
