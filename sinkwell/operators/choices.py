"""Bounded choices with several keys: areas of a map, trajectories, routes, samples of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored
from .ranking import CHOSEN


def area_order() -> list[Column]:
    """Most findings first, then sinks, then sources, then the path."""
    return [F.desc("findings"), F.desc("sinks"), F.desc("sources"), F.asc("path")]


def select_areas(areas: DataFrame, trajectories: DataFrame, focus: str | None = None, most: int = CHOSEN, most_trajectories: int = CHOSEN) -> DataFrame:
    """WIN-15: at most ``most`` areas, with the ``tier`` that chose them and their ``turn`` in it.

    0  the focus, if there is such an area
    1  the areas of the first trajectories, those through the focus first, then by burden and id, each in the order of its path
    2  the areas with sources and those with sinks in turns, each list in the order of areas
    3  the rest by path

    ``areas`` has id, path, findings, sinks and sources; ``trajectories`` id, burden and areas (array).  No list is longer than the choice, so each
    comes from a limit and only its rows are numbered.
    """
    areas = stored(areas.filter("id is not null").dropDuplicates(["id"]), "areas")

    def numbered(rows: DataFrame, order: list, n: int) -> DataFrame:
        return rows.orderBy(*order).limit(n).withColumn("_n", F.row_number().over(W.orderBy(*order)))

    through = F.coalesce(F.array_contains("areas", F.lit(focus)), F.lit(False)) if focus is not None else F.lit(False)
    paths = numbered(trajectories.select("id", "burden", "areas", through.alias("_through")), [F.desc("_through"), F.desc("burden"), F.asc("id")], most_trajectories)
    steps = paths.select("_n", F.posexplode("areas").alias("_at", "id"))
    turn = lambda tier, *at: F.struct(F.lit(tier).alias("tier"), *(F.col(x).cast("long").alias(f"at{i}") for i, x in enumerate(at)))
    known = areas.select("id")
    tiers = [steps.join(known, "id", "left_semi").select("id", turn(1, "_n", "_at").alias("turn"))]
    for second, name in enumerate(("sources", "sinks")):
        tiers.append(numbered(areas.filter(F.col(name) > 0), area_order(), most).withColumn("_second", F.lit(second)).select("id", turn(2, "_n", "_second").alias("turn")))
    tiers.append(numbered(areas, [F.asc("path"), F.asc("id")], 2 * most).withColumn("_second", F.lit(0)).select("id", turn(3, "_n", "_second").alias("turn")))
    if focus is not None:
        tiers.append(areas.filter(F.col("id") == focus).select("id", F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("at0"), F.lit(0).cast("long").alias("at1")).alias("turn")))
    first = reduce(DataFrame.union, tiers).groupBy("id").agg(F.min("turn").alias("turn")).orderBy("turn", "id").limit(most)
    return areas.join(first, "id").select(*areas.columns, "turn.tier").orderBy(*area_order())


def complex_first(trajectories: DataFrame, n: int = CHOSEN) -> DataFrame:
    """WIN-18: the ``n`` most complex trajectories: by length, substitutions, whether they are complete, label of the end, key."""
    return trajectories.orderBy(F.desc("length"), F.desc("substitutions"), F.desc("complete"), "terminal", "key").limit(n)


#: Metrics of WIN-25 by the name under which they are asked for.
ATLAS = {"steps": "total_steps", "paths": "trajectories", "unique": "unique_steps", "substitutions": "substitutions", "gaps": "gaps"}


def route_atlas(routes: DataFrame, kind: str = "all", sort: str = "steps", text: str | None = None, source: str | None = None) -> DataFrame:
    """WIN-25: all routes that pass the filters, by the metric, then by pattern; no cap.

    ``routes`` has kind, pattern, file, sources (array of key and label) and the metrics of ``ATLAS``.  ``text`` is looked for, in any case, in the pattern, the
    file and the labels of the sources; ``source`` is a key, of which an unknown one filters nothing.
    """
    if sort not in ATLAS or kind not in ("all", "page", "api"):
        raise ValueError("unknown metric or kind")
    rows = routes if kind == "all" else routes.filter(F.col("kind") == kind)
    needle = (text or "").strip().lower()
    if needle:
        labels = F.transform("sources", lambda s: F.coalesce(s["label"], F.lit("")))
        whole = F.lower(F.concat_ws(" ", F.coalesce("pattern", F.lit("")), F.coalesce("file", F.lit("")), F.array_join(labels, " ")))
        rows = rows.filter(whole.contains(needle))
    if source is not None:
        known = routes.select(F.explode("sources.key").alias("_key")).agg(F.coalesce(F.bool_or(F.col("_key") == source), F.lit(False)).alias("k")).scalar()
        rows = rows.filter(~known | F.array_contains("sources.key", source))
    return rows.orderBy(F.desc(ATLAS[sort]), "pattern")


def bounded_graph(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """SNK-3: part (node or edge), seq, id of the first ``n`` of each by ``seq``, and how many were ``omitted`` of that part."""
    out = []
    for part, rows in (("node", nodes), ("edge", edges)):
        total = rows.agg(F.count("*").alias("n")).scalar()
        first = rows.select("seq", "id").orderBy("seq", "id").limit(n)
        out.append(first.select(F.lit(part).alias("part"), "seq", "id", F.greatest(total - n, F.lit(0).cast("long")).alias("omitted")))
    return out[0].union(out[1])
