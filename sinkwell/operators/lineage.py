"""Field lineage: states of an element and a stack of field segments, followed along relations until nothing is new.

A relation keeps the stack, pushes its segment (``wrap``) or pops it (``read``); all others stop the state with a reason.  States are
deduplicated over origin, element and stack, so a cycle that comes back to a state ends by itself, and a cycle that pushes more than it pops ends
at the bound of the stack.  The search goes level by level for all origins at once; relations are laid out once (`Layout`), and whatever does not
depend on the state, such as whether a relation is the only one of its kind, is decided before the search by aggregates.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import release, stored, stored_by
from .layout import Layout

#: Relations that keep a field as it is.
KEEP = ("alias", "argument", "return", "result")
#: Kinds of which an element may have one only: leading out, leading in.
SOLE_OUT, SOLE_IN = ("argument", "return"), ("result",)
#: Segments of a stack.
MOST_SEGMENTS = 16
#: Tables of known states that a level is compared with.
MOST_TABLES = 8
#: Frontiers that are reported.  The bound of the reported contract.
MOST_FRONTIERS = 256


def judged(relations: DataFrame) -> DataFrame:
    """src, dst, kind, segment and ``refused``: why no state may follow the relation, whatever its stack.

    partial-proof          the relation is not proven
    unsupported-relation   a kind that no rule knows
    ambiguous-target       an argument or a return that goes to more than one element
    multiple-origins       a result that comes from more than one element
    dynamic-index          a wrap or read whose segment is not known
    """
    rows = stored(relations.select("src", "dst", "kind", "segment", "status").distinct(), "relations")
    proven = rows.filter("status = 'proven'")
    # a kind with one target only has the same least and greatest one; no distinct values are gathered
    out = proven.filter(F.col("kind").isin(*SOLE_OUT)).groupBy(F.col("src").alias("_src"), F.col("kind").alias("_kind_out")).agg((F.min("dst") != F.max("dst")).alias("_split"))
    into = proven.filter(F.col("kind").isin(*SOLE_IN)).groupBy(F.col("dst").alias("_dst"), F.col("kind").alias("_kind_in")).agg((F.min("src") != F.max("src")).alias("_merged"))
    out, into = stored(out.filter("_split"), "split"), stored(into.filter("_merged"), "merged")
    rows = rows.join(out, (F.col("src") == F.col("_src")) & (F.col("kind") == F.col("_kind_out")), "left")
    rows = rows.join(into, (F.col("dst") == F.col("_dst")) & (F.col("kind") == F.col("_kind_in")), "left")
    kind = F.col("kind")
    refused = (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "proven", "partial-proof")
        .when(F.coalesce(~kind.isin(*KEEP, "wrap", "read"), F.lit(True)), "unsupported-relation")
        .when(F.col("_split"), "ambiguous-target")
        .when(F.col("_merged"), "multiple-origins")
        .when(kind.isin("wrap", "read") & F.col("segment").isNull(), "dynamic-index")
    )
    return rows.select("src", "dst", "kind", "segment", refused.alias("refused"))


def field_lineage(starts: DataFrame, relations: DataFrame, gaps: DataFrame | None = None, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """GRF-15 to its fixpoint: origin, id, field, stop, target, gap and hop.

    ``starts`` has origin, id and field (array of segments); ``relations`` src, dst, kind, segment and status; ``gaps`` id and src.
    A row with neither ``stop`` nor ``gap`` is a state that was reached, with the least number of hops.  A row with a ``stop`` is a relation to
    ``target`` that the state could not follow: one of the reasons of ``judged``, ``field-mismatch`` where a read asks for another segment than the
    first, ``budget-exhausted`` where a wrap would go beyond the bound.  A state on an element with gaps goes no further and names the least ``gap``.
    Starts with a null field or id are none; repeated starts and relations are one.
    """
    ways = judged(relations)
    first = starts.select(F.coalesce(F.concat(F.lit("="), F.col("origin").cast("string")), F.lit("")).alias("_origin"), "id", "field").filter("id is not null and field is not null")
    if gaps is None:
        none = F.lit(None).cast("string")
        first, ways = first.withColumn("gap", none), ways.withColumn("gap", none)
    else:  # the gap of an element comes with the relation that leads to it, so no level looks it up
        gaps = stored(gaps.filter("src is not null").groupBy(F.col("src").alias("_gap_src")).agg(F.min("id").alias("gap")), "gaps")
        first = first.join(gaps, F.col("id") == F.col("_gap_src"), "left").drop("_gap_src")
        ways = ways.join(gaps, F.col("dst") == F.col("_gap_src"), "left").drop("_gap_src")
    ways = Layout(ways.withColumnRenamed("gap", "dst_gap"), starts=relations.select("src"))

    # states lie in buckets of their keys, which are never null: a level exchanges its own states only, however many are known
    keys = ["_origin", "id", "field"]
    n = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = stored_by(first.withColumn("hop", F.lit(0)), keys, "states", distinct=True)
    seen = [front]
    kind, field, segment = F.col("kind"), F.col("field"), F.col("segment")
    after = (
        F.when(kind.isin(*KEEP), field)
        .when((kind == "wrap") & (F.size(field) < most_segments), F.concat(F.array(segment), field))
        .when((kind == "read") & (F.try_element_at(field, F.lit(1)) == segment), F.slice(field, 2, F.greatest(F.size(field) - 1, F.lit(0))))
    )

    def moved(states: DataFrame) -> DataFrame:
        return ways.step(states.filter("gap is null"), "id").withColumn("_after", F.when(F.col("refused").isNull(), after))

    for hop in count(1):
        new = moved(front).filter("_after is not null").select("_origin", F.col("dst").alias("id"), F.col("_after").alias("field"), F.col("dst_gap").alias("gap"))
        new = new.repartition(n, *keys).distinct()
        for s in seen:
            known = s.select(*(F.col(k).alias(f"_known_{k}") for k in keys))
            new = new.join(known, [F.col(k) == F.col(f"_known_{k}") for k in keys], "left_anti")
        front = stored_by(new.withColumn("hop", F.lit(hop)), keys, "states", dealt=True)
        if front.isEmpty():
            break
        if len(seen) == MOST_TABLES:  # later levels are small; they become one table
            small = seen[MOST_TABLES // 2 :]
            seen[MOST_TABLES // 2 :] = [stored_by(reduce(DataFrame.union, small), keys, "states")]
            release(*small[:-1])  # the last one is the front before this
        seen.append(front)
    own = F.when(F.col("_origin") != "", F.expr("substring(_origin, 2)")).cast(starts.schema["origin"].dataType).alias("origin")
    states = reduce(DataFrame.union, seen)
    stop = F.coalesce("refused", F.when(kind == "wrap", "budget-exhausted").otherwise("field-mismatch"))
    ended = moved(states).filter("_after is null").select(own, "id", "field", stop.alias("stop"), F.col("dst").alias("target"), F.lit(None).cast("string").alias("gap"), "hop")
    none = F.lit(None).cast("string")
    return states.select(own, "id", "field", none.alias("stop"), none.alias("target"), "gap", "hop").union(ended.distinct())


def frontiers(lineage: DataFrame, most: int = MOST_FRONTIERS, by: str | None = None) -> DataFrame:
    """GRF-26: the states that a gap stopped, with reason ``evidence-truncated``; the first ``most``, of each value of ``by`` if one is given.

    They are ordered by origin, field and element.
    """
    rows = lineage.filter("gap is not null").select("origin", "field", "id", "gap", "hop", *([by] if by and by != "origin" else []))
    rows = rows.withColumn("reason", F.lit("evidence-truncated"))
    order = ["origin", "field", "id"]
    if by is None:
        return rows.orderBy(*order).limit(most)
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")

