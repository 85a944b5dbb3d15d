"""Graph operators over an edge table (src, dst, kind, unknown)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored
from .layout import Layout


def degrees(edges: DataFrame) -> DataFrame:
    """AGG-27: distinct neighbours in and out."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_in"))
    return out.join(into, "id", "full_outer").na.fill(0)


#: Hops of a path, after which it is given as truncated.  The bound of the reported contract.
MOST_HOPS = 120


def levels(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """GRF-1/GRF-10: breadth-first distance of every vertex reached from ``seeds`` (id); one join per level, no path is kept.

    Edges are laid out once and every level is written, so a level never runs the ones before it again.  The search ends with an empty level, or
    after ``depth`` levels where one is given.
    """
    hops = Layout(edges.select("src", "dst"))
    seen = front = seeds.select("id").distinct().withColumn("distance", F.lit(0))
    for d in count(1):
        if depth is not None and d > depth:
            return seen
        new = hops.step(front, "id").select(F.col("dst").alias("id")).distinct()
        front = stored(new.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)), "level")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def simple_paths(edges: DataFrame, ends: DataFrame, depth: int = MOST_HOPS) -> DataFrame:
    """GRF-6: all simple paths that lead to ``ends`` (id), backwards, as arrays in forward order, to the sources.

    Edges are laid out once and every level is written; repeated edges are one.  ``truncated`` marks paths that were still open after ``depth`` hops.
    """
    into = Layout(edges.select(F.col("dst").alias("src"), F.col("src").alias("before")))
    open_, done = ends.select(F.array("id").alias("path")), []
    for hop in range(depth):
        step = into.step(open_.withColumn("_head", F.element_at("path", 1)), "_head", "left", crowded=hop > 0)
        step = stored(step.filter(F.col("before").isNull() | ~F.array_contains("path", F.col("before"))).select("path", "before"), "paths")
        done.append(step.filter("before is null").select("path", F.lit(False).alias("truncated")))
        open_ = step.filter("before is not null").select(F.concat(F.array("before"), "path").alias("path"))
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
    return reduce(DataFrame.union, [*done, open_.withColumn("truncated", F.lit(True))])


def merged_steps(paths: DataFrame) -> DataFrame:
    """AGG-29: canonical edges of all paths with the number of paths and the least depth."""
    at = F.sequence(F.lit(1), F.size("path") - 1)
    pairs = F.transform(at, lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst"), (F.size("path") - i).alias("depth")))
    rows = paths.filter(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.*")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("paths"), F.min("depth").alias("min_depth"))


def stitched(segments: DataFrame, depth: int = MOST_HOPS) -> DataFrame:
    """JOIN-12/GRF-7: whole paths from segments that components hand to one another.

    A segment has a ``path``, the label that it ``feeds`` (null: it ends in a sink), the label it is ``fed_by`` (null: it begins at a
    source) and its ``component``.  A segment is joined upstream only at a label with exactly one producing component, and at no label
    twice.  Levels are written until no path grows.  Returns label (the first hand-off met, seen from the sink), path, hops and
    ``truncated``; segments without a hand-off are no stitched paths.
    """
    known = segments.select("feeds", "fed_by", "component", "path")
    sole = known.filter("feeds is not null").groupBy("feeds").agg(F.count_distinct("component").alias("n")).filter("n = 1").select("feeds")
    made = stored(known.join(sole, "feeds").select(F.col("feeds").alias("_at"), F.col("fed_by").alias("_next"), F.col("path").alias("_before")), "producers")
    empty = F.array().cast("array<string>")
    open_ = known.filter("feeds is null and fed_by is not null").select(F.col("fed_by").alias("label"), "fed_by", "path", empty.alias("seen"))
    done = []
    for hops in range(depth):
        step = open_.join(made, (F.col("fed_by") == F.col("_at")) & ~F.array_contains("seen", F.col("fed_by")), "left")
        step = stored(step, "stitches")
        ends = step.filter("_before is null").filter(F.lit(hops > 0))  # no producer, or a label met before
        done.append(ends.select("label", "path", F.lit(hops).alias("hops"), F.lit(False).alias("truncated")))
        grown = step.filter("_before is not null").select("label", F.col("_next").alias("fed_by"), F.concat("_before", "path").alias("path"), F.array_append("seen", F.col("fed_by")).alias("seen"))
        done.append(grown.filter("fed_by is null").select("label", "path", F.lit(hops + 1).alias("hops"), F.lit(False).alias("truncated")))
        open_ = grown.filter("fed_by is not null")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
    return reduce(DataFrame.union, [*done, open_.select("label", "path", F.lit(depth).alias("hops"), F.lit(True).alias("truncated"))])


def contract(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """GRF-18: drop the hidden vertices and connect what they linked, through chains of any length."""
    gone = stored(hidden.select(F.col("id").alias("_h")).distinct(), "hidden")
    rows = stored(edges.select("src", "dst").distinct(), "rows")
    nxt = rows.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    front = rows.join(gone, F.col("src") == F.col("_h"), "left_anti")
    out, seen = [], None
    while True:
        out.append(front.join(gone, F.col("dst") == F.col("_h"), "left_anti"))
        stuck = front.join(gone, F.col("dst") == F.col("_h"), "left_semi").select("src", F.col("dst").alias("_via"))
        stuck = stored(stuck if seen is None else stuck.join(seen, ["src", "_via"], "left_anti"), "stuck")
        if stuck.isEmpty():
            return reduce(DataFrame.union, out).filter("src <> dst").distinct()
        seen = stuck if seen is None else seen.union(stuck)
        front = stored(stuck.join(nxt, F.col("_via") == F.col("_from")).select("src", F.col("_to").alias("dst")).distinct(), "front")


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-14: an equi join that holds only where the key is unique on both sides."""
    def sole(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter("_n = 1").drop("_n")

    return sole(left).join(sole(right), keys)


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """JOIN-7: points inside ranges of the same key; ranges are dealt into bins of ``width``, so it is an equi join with a filter."""
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    dealt = ranges.withColumn("_bin", bins)
    rows = points.withColumn("_bin", F.floor(F.col(at) / width))
    return rows.join(dealt, [key, "_bin"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_bin")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-21/VAL-2: edge ends that are no node."""
    ends = edges.select(F.col("src").alias("id"), F.lit("src").alias("end")).union(edges.select("dst", F.lit("dst")))
    return ends.join(nodes.select("id"), "id", "left_anti").groupBy("id", "end").agg(F.count("*").alias("n"))


def checked_gaps(gaps: DataFrame, elements: DataFrame) -> DataFrame:
    """VAL-6: ``gaps`` (id, src, dst), unchanged; an end that is not null and no element fails the job when the gaps are read."""
    known = elements.select("id").distinct()
    out = gaps
    for end in ("src", "dst"):
        out = out.join(known.select(F.col("id").alias(f"_{end}")), F.col(end) == F.col(f"_{end}"), "left")
        bad = F.col(end).isNotNull() & F.col(f"_{end}").isNull()
        text = F.concat(F.lit("gap "), F.col("id").cast("string"), F.lit(f" has an unknown {end} "), F.col(end).cast("string"))
        out = out.withColumn(end, F.when(bad, F.raise_error(text).cast(gaps.schema[end].dataType)).otherwise(F.col(end))).drop(f"_{end}")
    return out


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """VAL-1: ids that occur more than once."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def best_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GRF-12: per vertex the shortest path from a seed, ties to the least path; partial if any step is.

    ``edges`` has src, dst and status.  Only the best path of each vertex goes on to the next level, until a level is empty.
    """
    hops = Layout(edges.select("src", "dst", "status"))
    seen = front = seeds.select("id", F.array("id").alias("path"), F.lit(False).alias("partial"))
    while True:
        step = hops.step(front, "id")
        step = step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("partial") | (F.col("status") == "partial")).alias("partial"))
        best = step.groupBy("id").agg(F.min(F.struct("path", "partial")).alias("b")).select("id", "b.*")
        front = stored(best.join(seen.select("id"), "id", "left_anti"), "level")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def field_transitions(states: DataFrame, relations: DataFrame) -> DataFrame:
    """GRF-15: one step of a field along relations: preserve, extend by a segment, drop a segment, or stop with a reason.

    ``states`` has id and field (array of segments); ``relations`` has src, dst, kind and segment.
    """
    rows = states.join(relations, F.col("id") == F.col("src"))
    kind, field = F.col("kind"), F.col("field")
    after = (
        F.when(kind.isin("alias", "argument", "return"), field)
        .when(kind == "wrap", F.concat(F.array("segment"), field))
        .when((kind == "read") & (F.try_element_at(field, F.lit(1)) == F.col("segment")), F.slice(field, 2, F.greatest(F.size(field) - 1, F.lit(0))))
    )
    reason = F.when(after.isNull(), F.when(kind == "read", "field-mismatch").otherwise("unsupported-relation"))
    return rows.select("src", F.col("dst").alias("id"), after.alias("field"), reason.alias("stop"))
