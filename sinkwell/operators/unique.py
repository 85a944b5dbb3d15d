"""Paths that must be the only one: counts saturated at two, and a search that fails closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import stored
from .layout import Layout

#: Bounds of the reported contract: states and hops of one origin.
MOST_STATES, MOST_HOPS = 256, 24


def unique_search(edges: DataFrame, origins: DataFrame, ends: DataFrame, most_states: int | None = MOST_STATES, most_hops: int = MOST_HOPS) -> DataFrame:
    """GRF-13, GRF-14: origin, end, result and path, where ``result`` tells whether exactly one simple path leads from an origin to an end.

    unique      exactly one, which is the ``path``
    several     more than one
    exhausted   not known, because the origin has more than ``most_states`` states (a vertex at a number of hops) or an open way after ``most_hops``;
                a row without an end tells that further ends may be missing
    An end ends a path; an end that is not reached has no row.  ``edges`` has src and dst, ``origins`` and ``ends`` an id; repeated rows are one.

    A state keeps two of its paths at most, the least and the greatest, and whether there are more.  So a level has one row for a vertex
    however many paths lead to it: all of 2**40 paths through forty diamonds are two witnesses a level.  Both witnesses are real paths, so two
    of them at an end settle it.  Where a cycle blocks a witness of a state that had more paths than it kept, the kept ones can no longer
    tell whether there is one; then the origin is exhausted, never unique.
    """
    last = stored(ends.select(F.col("id").alias("_end")).filter("id is not null").distinct(), "ends")
    known = edges.select("src", "dst").filter("dst is not null")
    rows = known.join(last, F.col("dst") == F.col("_end"), "left")
    ways = Layout(rows.select("src", "dst", F.col("_end").isNotNull().alias("ends")), starts=known.select("src"))
    # of a path only what lies between its origin and its vertex is kept; ``high`` is null where it is ``low``
    front = origins.filter("id is not null").select(F.col("id").alias("origin"), "id").distinct()
    front = front.select("origin", "id", F.array().cast("array<string>").alias("low"), F.lit(None).cast("array<string>").alias("high"), F.lit(False).alias("more"), F.lit(1).cast("long").alias("used"))
    levels, lost = [], []
    for hop in range(most_hops + 1):
        met = ways.step(front, "id", crowded=hop > 0)
        kept = F.when(F.col("high").isNull(), F.array("low")).otherwise(F.array("low", "high"))
        met = met.withColumn("_via", F.explode(kept)).withColumn("_met", F.col("dst").isin(F.col("origin"), F.col("id")) | F.array_contains("_via", F.col("dst")))
        via = F.when(~F.col("_met"), F.array_append("_via", F.col("id")) if hop else F.col("_via"))
        met = met.select("origin", F.col("dst").alias("id"), "ends", via.alias("_path"), "more", (F.col("_met") & F.col("more")).alias("_unsure"), "used")
        if most_states is not None:
            met = met.repartition("origin")  # the states of an origin are counted, so its rows are exchanged once for both
        level = met.groupBy("origin", "id", "ends").agg(
            F.min("_path").alias("low"), F.max("_path").alias("high"), (F.bool_or("more") | (F.count("_path") > 2)).alias("more"), F.bool_or("_unsure").alias("unsure"), F.max("used").alias("used")
        )
        level = level.withColumn("high", F.when(F.col("high") != F.col("low"), F.col("high")))
        if most_states is not None:
            level = level.withColumn("used", F.col("used") + F.count_if(~F.col("ends") & F.col("low").isNotNull()).over(W.partitionBy("origin")))
        level = stored(level, "paths")
        levels.append(level.filter("ends and low is not null"))
        lost.append(level.filter("unsure").select("origin"))
        front = level.filter("not ends and low is not null").select("origin", "id", "low", "high", "more", "used")
        if hop == most_hops:
            lost.append(front.select("origin"))
            break
        if most_states is not None:
            lost.append(front.filter(F.col("used") > most_states).select("origin"))
            front = front.filter(F.col("used") <= most_states)
        if front.isEmpty():
            break
    lost = stored(reduce(DataFrame.union, lost).distinct(), "lost")
    found = reduce(DataFrame.union, levels).groupBy("origin", F.col("id").alias("end")).agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"), F.bool_or("more").alias("more"))
    found = found.join(lost.select(F.col("origin").alias("_origin")), F.col("origin") == F.col("_origin"), "left")
    one = (F.col("low") == F.col("high")) & ~F.col("more")
    result = F.when(F.col("low") != F.col("high"), "several").when(F.col("_origin").isNotNull() | ~one, "exhausted").otherwise("unique")
    out = found.withColumn("result", result).select("origin", "end", "result", F.when(F.col("result") == "unique", F.concat(F.array("origin"), "low", F.array("end"))).alias("path"))
    none = F.lit(None).cast("string")
    return out.union(lost.select("origin", none, F.lit("exhausted"), F.lit(None).cast("array<string>")))
