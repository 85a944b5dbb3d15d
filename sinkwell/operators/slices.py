"""Bounded slices around many seeds at once, best first, with budgets and gaps.

The order in which a slice takes its elements depends on all it has taken before, so it is a loop; but a slice is bounded, and so is what its
loop reads.  All seeds advance together.  At first joins load the neighbours of the seeds hop by hop, for each seed as long as all that it has met is
no more than a slice can take; where no budget binds, the loops then find all that they ask for and run once.  The others go on in rounds.  A round runs every loop over the neighbours that are loaded; a loop that takes an
element whose neighbours are not loaded stops and names the unloaded elements of its queue, and of those that its loaded elements lead to as many as it
may still take; a join loads them for all seeds, and the loop starts again.  Every round takes a loop one element further at least, so there are no more
rounds than elements in a slice.  A loop inspects no more relations than its work budget, so
of an element's neighbours, in their order, no more are ever kept or sent.

Relations are laid out once by the element at which they start.  A hop or round puts the neighbours of the distinct elements asked for in their order,
then joins the seeds with what was found, so an element that every seed asks for is read once, and one that no seed asks for is not put in order at all.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import prod

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import release, stored, stored_by


@dataclass(frozen=True)
class Limits:
    """The budgets of a slice.  Fixed values of the reported contract; ``work`` is the sum of elements and relations if it is not given."""

    depth: int = 48
    elements: int = 128
    relations: int = 256
    terminals: int = 64
    work: int | None = None
    stop_at_terminal: bool = False
    stop_at_boundary: bool = False
    #: Boundaries that are not entered.
    closed: tuple[str, ...] = ()

    def __post_init__(self):
        if min(self.depth, self.elements, self.relations, self.terminals, self.work or 1) < 1:
            raise ValueError("limits are positive")

    @property
    def visits(self) -> int:
        return self.work or self.elements + self.relations

    @property
    def gaps(self) -> int:
        return max(16, min(256, self.relations))


#: Relations with these states lead on.
ACCEPTED = ("proven", "partial")
ELEMENT = "struct<id:string,priority:int,origin:boolean,terminals:array<string>,boundary:boolean>"
MOVE = f"struct<n:int,relation:string,target:{ELEMENT},refused:string>"
SLICE = "elements array<struct<id:string,depth:int>>, relations array<string>, terminals array<struct<id:string,role:string>>, gaps array<struct<src:string,dst:string,reason:string,cause:string>>, work int, truncated array<string>"


#: Elements whose names, and elements whose neighbours, are broadcast at most.
FEW_NAMES, FEW_NEIGHBOURS = 10_000, 200
#: Names, or elements with what they lead to, that a task hashes at most on the average.
FEW_HASHED = 300_000
#: Without this Spark puts rows that are sorted already in order once more before it collects them.
OBJECT_HASH = "spark.sql.execution.useObjectHashAggregateExec"


def edges(relations: DataFrame, direction: str) -> DataFrame:
    """at, to, id and status: relations as they lead from an element, in one direction or both.

    A relation is named once at an element, also where a search in both directions meets it twice.
    """
    rows = relations.filter("src is not null and dst is not null").groupBy("id").agg(F.min(F.struct("src", "dst", "status")).alias("r")).select("id", "r.*")
    out = rows.select(F.col("src").alias("at"), F.col("dst").alias("to"), "id", "status")
    back = rows.select(F.col("dst").alias("at"), F.col("src").alias("to"), "id", "status")
    return {"forward": out, "backward": back, "both": out.union(back.filter(F.col("at") != F.col("to")))}[direction]


def neighbours(elements: DataFrame, moves: DataFrame, limits: Limits) -> DataFrame:
    """GRF-5: ``at`` and its ``moves`` in order: by priority of the target, its place, the relation's id; no more than a loop can inspect."""
    target = F.struct(F.col("priority").cast("int").alias("priority"), "origin", "terminals", F.col("boundary").isNotNull().alias("boundary"))
    met = moves.join(elements.withColumnsRenamed({"id": "_to", "status": "_status"}), F.col("to") == F.col("_to"), "left")
    refused = (
        F.when(F.col("_to").isNull(), "unproven-handoff")
        .when(F.col("boundary").isin(*limits.closed), "unsupported-boundary")
        .when(~F.coalesce(F.col("status").isin(*ACCEPTED), F.lit(False)) | (F.col("_status") == "unsupported"), "unproven-handoff")
    )
    n = F.row_number().over(W.partitionBy("at").orderBy(F.desc(F.coalesce(F.col("priority").cast("int"), F.lit(0))), F.asc_nulls_last("place"), "to", "id"))
    met = met.withColumn("refused", refused).withColumn("n", n).filter(F.col("n") <= limits.visits + 1)
    known = F.struct(F.col("to").alias("id"), *(target[c].alias(c) for c in ("priority", "origin", "terminals", "boundary")))
    unknown = F.struct(F.col("to").alias("id"), F.lit(0).alias("priority"), F.lit(False).alias("origin"), F.array().cast("array<string>").alias("terminals"), F.lit(False).alias("boundary"))
    move = F.struct("n", F.col("id").alias("relation"), F.when(F.col("_to").isNull(), unknown).otherwise(known).alias("target"), "refused")
    return met.groupBy("at").agg(F.array_sort(F.collect_list(move)).alias("moves"))


class Loop:
    """One slice as far as its neighbours are loaded."""

    def __init__(self, entry: dict | None, seed: str, loaded: dict[str, list[dict]], limits: Limits):
        self.limits, self.loaded = limits, loaded
        self.depth: dict[str, int] = {}
        self.known: dict[str, dict] = {}
        self.relations: dict[str, None] = {}
        self.terminals: list[tuple[str, str]] = []
        self.gaps: dict[tuple, None] = {}
        self.truncated: set[str] = set()
        self.queue: list[tuple[int, int, str]] = []
        self.work = 0
        self.wanted: list[str] = []
        if entry is None:
            self.gap(seed, None, "disconnected", "unknown seed")
        else:
            self.take(entry, 0)
            self.run()

    def gap(self, src: str | None, dst: str | None, reason: str, cause: str) -> None:
        key = (src, dst, reason, cause)
        if key not in self.gaps:
            if len(self.gaps) < self.limits.gaps:
                self.gaps[key] = None
            else:
                self.truncated.add("gaps")

    def over(self, budget: str, src: str | None, dst: str | None) -> None:
        self.truncated.add(budget)
        self.gap(src, dst, "budget-exhausted", budget)

    def take(self, element: dict, depth: int) -> bool:
        """Whether the element is in the slice, now or before."""
        name = element["id"]
        if name in self.depth:
            return True
        if len(self.depth) >= self.limits.elements:
            self.over("elements", next(iter(self.depth)), name)
            return False
        self.depth[name], self.known[name] = depth, element
        for role in element["terminals"]:
            if len(self.terminals) < self.limits.terminals:
                self.terminals.append((name, role))
            else:
                self.over("terminals", name, None)
        if not (self.limits.stop_at_terminal and element["terminals"]):
            heapq.heappush(self.queue, (-element["priority"], len(self.depth), name))
        return True

    def run(self) -> None:
        while self.queue:
            name = self.queue[0][2]
            if name not in self.loaded and self.work < self.limits.visits:
                self.wanted = self.ahead()
                return
            heapq.heappop(self.queue)
            if not self.expand(name):
                break
        if "work" in self.truncated and self.queue:
            self.gap(min(self.queue, key=lambda q: q[1])[2], None, "budget-exhausted", "work left")

    def ahead(self) -> list[str]:
        """What the loop may ask for next: the unloaded elements of the queue, then targets of the loaded ones."""
        names = [q[2] for q in sorted(self.queue)]
        wanted = dict.fromkeys(n for n in names if n not in self.loaded)
        for n in names:
            for move in self.loaded.get(n, ()):
                if len(wanted) >= self.limits.elements:
                    return list(wanted)
                if not move["refused"] and move["target"]["id"] not in self.loaded:
                    wanted[move["target"]["id"]] = None
        return list(wanted)

    def expand(self, name: str) -> bool:
        """Follow the relations of an element; False if the work budget is used up."""
        if self.work >= self.limits.visits:
            self.over("work", name, None)
            return False
        moves = self.loaded[name]
        if not moves and not self.known[name]["origin"] and not self.known[name]["terminals"]:
            self.gap(name, None, "disconnected", "no relation")
        for move in moves:
            target = move["target"]
            if self.work >= self.limits.visits:
                self.over("work", name, target["id"])
                return False
            self.work += 1
            if move["refused"]:
                self.gap(name, target["id"], move["refused"], move["relation"])
            elif self.depth[name] >= self.limits.depth and target["id"] not in self.depth:
                self.over("depth", name, target["id"])
            elif len(self.relations) >= self.limits.relations and move["relation"] not in self.relations:
                self.over("relations", name, target["id"])
            elif self.take(target, self.depth[name] + 1):
                self.relations[move["relation"]] = None
                if target["boundary"] and self.limits.stop_at_boundary:
                    self.gap(target["id"], None, "unsupported-boundary", "stop")
                    self.queue = [q for q in self.queue if q[2] != target["id"]]
                    heapq.heapify(self.queue)
        return True

    def result(self) -> dict:
        inside = lambda x: x if x in self.depth else None  # noqa: E731  (ends outside of the slice are not named)
        return {
            "elements": [{"id": i, "depth": d} for i, d in self.depth.items()],
            "relations": list(self.relations),
            "terminals": [{"id": i, "role": r} for i, r in self.terminals],
            "gaps": [{"src": inside(s), "dst": inside(d), "reason": r, "cause": c} for s, d, r, c in self.gaps],
            "work": self.work,
            "truncated": sorted(self.truncated),
        }


#: Seeds that a worker unpacks at once.
PIECE = 256


def _parts(rows: list, lengths: pa.Array) -> Iterator[list]:
    """``rows`` dealt to lists of these lengths; null is empty."""
    end = 0
    for n in lengths.fill_null(0).to_numpy(zero_copy_only=False).tolist():
        start, end = end, end + n
        yield rows[start:end]


def _loaded(known: pa.Array) -> Iterator[dict[str, list[dict]]]:
    """For every seed the moves by element, read column by column."""
    plain = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    at, moves = known.flatten().flatten()
    _, relation, target, refused = moves.flatten().flatten()
    name, priority, origin, terminals, boundary = target.flatten()
    targets = [
        {"id": i, "priority": int(p), "origin": o, "terminals": t, "boundary": b}
        for i, p, o, t, b in zip(*map(plain, (name, priority, origin)), _parts(plain(terminals.flatten()), terminals.value_lengths()), plain(boundary), strict=True)
    ]
    rows = [{"relation": r, "target": t, "refused": x} for r, t, x in zip(plain(relation), targets, plain(refused), strict=True)]
    pairs = list(zip(plain(at), _parts(rows, moves.value_lengths()), strict=True))
    return map(dict, _parts(pairs, known.value_lengths()))


def _round(limits: Limits, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PIECE) for whole in batches for i in range(0, whole.num_rows, PIECE)):
            out = []
            for seed, entry, seen, known in zip(*(b.column(i).to_pylist() for i in range(3)), _loaded(b.column(3)), strict=True):
                loop = Loop(entry, seed, dict.fromkeys(seen, ()) | known, limits)
                done = {} if loop.wanted else loop.result()
                out.append({"seed": seed, "wanted": loop.wanted, "left": limits.visits - loop.work + 1, **done})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _load(state: DataFrame, known: DataFrame, moves: DataFrame, limits: Limits) -> DataFrame | None:
    """seed, at and moves of what the seeds ask for; None if they ask for nothing.

    Names and neighbours are broadcast where they are few, as counted; other joins are by exchange, as stored tables are many times their size in memory.
    """
    asked = state.select("seed", "left", F.explode("front").alias("at"))
    names = stored(asked.select(F.col("at").alias("_at")).distinct(), "names")
    n = names.count()
    if not n:
        release(names)
        return None
    near = moves.join(F.broadcast(names) if n <= FEW_NAMES else names.hint("merge"), F.col("at") == F.col("_at"), "left_semi")
    found = neighbours(known, near, limits).withColumnRenamed("at", "_there")
    met = asked.join(F.broadcast(found) if n <= FEW_NEIGHBOURS else found.hint("merge"), F.col("at") == F.col("_there"))
    out = stored(met.select("seed", "at", F.slice("moves", F.lit(1), F.col("left")).alias("moves")), "loaded")
    release(names)
    return out


def _grown(state: DataFrame, loaded: DataFrame, limits: Limits) -> DataFrame:
    """The seeds with the targets of what they loaded, as far as all that a seed has seen is no more than a slice can take."""
    led = F.transform(F.filter("moves", lambda m: m["refused"].isNull()), lambda m: m["target"]["id"])
    more = loaded.groupBy(F.col("seed").alias("_seed")).agg(F.array_distinct(F.flatten(F.collect_list(led))).alias("_led"))
    rows = state.join(more.hint("merge"), F.col("seed") == F.col("_seed"), "left")
    rows = rows.withColumn("_new", F.array_except(F.coalesce("_led", F.array().cast("array<string>")), "seen"))
    fits = F.size("seen") + F.size("_new") <= limits.elements
    return rows.select("seed", "entry", "left", F.when(fits, F.concat("seen", "_new")).otherwise(F.col("seen")).alias("seen"), F.when(fits, F.col("_new")).otherwise(F.array().cast("array<string>")).alias("front"))


def slices(elements: DataFrame, relations: DataFrame, seeds: DataFrame, direction: str = "forward", limits: Limits = Limits(), gaps: DataFrame | None = None) -> DataFrame:
    """GRF-2, GRF-3, GRF-4: for every seed (id) its elements with their depth, relations, terminals, gaps, work done and the budgets that were ``truncated``.

    ``elements`` has id, priority (higher ones are taken first, equal ones in the order in which they were found), place (orders the neighbours of an
    element), status, boundary, origin and terminals (its roles that count); ``relations`` id, src, dst and status; ``gaps`` id, src, dst and
    reason, of which those that start in the slice are added.  ``direction`` is forward, backward or both.  An unknown seed has an empty slice with a
    gap; repeated seeds, elements (the least row counts) and relation ids are one; null seeds are none.
    """
    one = elements.filter("id is not null").groupBy("id").agg(F.min(F.struct("priority", "place", "status", "boundary", "origin", "terminals")).alias("e"))
    known = stored_by(one.select("id", "e.*"), ["id"], "elements")
    moves = stored_by(edges(relations, direction), ["at"], "edges")
    entry = F.struct("id", F.col("priority").cast("int").alias("priority"), "origin", "terminals", F.col("boundary").isNotNull().alias("boundary"))
    start = seeds.filter("id is not null").select(F.col("id").alias("seed")).distinct().join(known.select(entry.alias("entry")), F.col("seed") == F.col("entry.id"), "left")
    first = F.when(F.col("entry").isNull(), F.array().cast("array<string>")).otherwise(F.array("seed"))
    state = stored_by(start.select("seed", "entry", F.lit(limits.visits + 1).alias("left"), first.alias("seen"), first.alias("front")), ["seed"], "seeds")

    n = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that rounds of small rows are not put into one task
    schema = f"seed string, wanted array<string>, left int, {SLICE}"
    arrow = _arrow_schema(start.sparkSession, schema)
    loaded: list[DataFrame] = []
    while (got := _load(state, known, moves, limits)) is not None:  # hop by hop, before any loop runs
        loaded.append(got)
        before, state = state, stored_by(_grown(state, got, limits), ["seed"], "seeds")
        release(before)
    done: list[DataFrame] = []
    while True:
        rows = state.select("seed", "entry", "seen")
        if loaded:
            here = reduce(DataFrame.union, loaded)
            if done:
                here = here.join(state.select(F.col("seed").alias("_seed")).hint("merge"), F.col("seed") == F.col("_seed"), "left_semi")
            here = here.repartition(n, "seed").groupBy(F.col("seed").alias("_seed")).agg(F.collect_list(F.struct("at", "moves")).alias("known"))
            rows = rows.join(here.hint("merge"), F.col("seed") == F.col("_seed"), "left").drop("_seed")
        else:
            rows = rows.withColumn("known", F.lit(None).cast(f"array<struct<at:string,moves:array<{MOVE}>>>"))
        ran = stored(rows.mapInArrow(_round(limits, arrow), schema), "slices")
        done.append(ran.filter(F.size("wanted") == 0))
        going = ran.filter(F.size("wanted") > 0).select(F.col("seed").alias("_seed"), "wanted", F.col("left").alias("_left"))
        if going.isEmpty():
            break
        more = state.join(going.hint("merge"), F.col("seed") == F.col("_seed")).select("seed", "entry", F.col("_left").alias("left"), F.array_union("seen", "wanted").alias("seen"), F.col("wanted").alias("front"))
        before, state = state, stored_by(more, ["seed"], "seeds")
        release(before)
        if (got := _load(state, known, moves, limits)) is not None:
            loaded.append(got)
    release(moves, state, *loaded)
    out = reduce(DataFrame.union, done).drop("wanted", "left")
    return out if gaps is None else _with_gaps(out, gaps, limits)


def _oriented(relations: DataFrame, direction: str) -> DataFrame:
    """at, to, id and status, repeated rows included; forward or backward."""
    at, to = ("src", "dst") if direction == "forward" else ("dst", "src")
    return relations.filter("id is not null and src is not null and dst is not null").select(F.col(at).alias("at"), F.col(to).alias("to"), "id", "status")


def _radix(limits: Limits) -> tuple[int, ...]:
    """Bounds of what the elements of a slice within its budgets add up to: work, refused moves, elements that lead nowhere, terminals."""
    work = limits.elements * limits.visits + 1
    return work, work, limits.elements + 1, limits.elements * limits.terminals + 1


def _digit(number: Column, radix: tuple[int, ...], i: int) -> Column:
    """A part of numbers that were added up in one."""
    rest = number
    for bound in radix[:i:-1]:
        rest = F.call_function("div", rest, F.lit(bound))
    return rest % radix[i]


def _by(rows: int, n: int) -> str:
    """How rows of short names are met: by hash where a task of n holds few of them, else sorted."""
    return "shuffle_hash" if rows <= FEW_HASHED * n else "merge"


def _closed(entries: DataFrame, front: DataFrame, ends: DataFrame, limits: Limits) -> DataFrame:
    """id, ``whole`` and, if so, ``all`` that the entries (id, bare, terms) lead to, themselves included, from their moves and what the ends of these lead to.

    An element stands there as a text, since texts are compared fast: what it adds to the sums in one number, a blank and its id.
    """
    n = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refused = ~F.col("ok") | ~F.coalesce("enter", F.lit(False))
    rows = front.join(ends, F.col("to") == F.col("_end"), "left").select("at", refused.alias("refused"), (refused | F.coalesce("_whole", F.lit(False))).alias("_whole"), F.when(~refused, F.col("_all")).alias("_all"))
    k = F.row_number().over(W.partitionBy("at").orderBy("at"))  # an element with more moves than a loop can inspect is not whole
    rows = rows.repartition(n, "at").withColumn("_k", k).filter(F.col("_k") <= limits.visits)
    led = rows.groupBy("at").agg(F.count("*").cast("int").alias("_work"), F.count_if("refused").cast("int").alias("_refused"), F.flatten(F.collect_list("_all")).alias("_led"), F.bool_and("_whole").alias("_whole"))
    work = F.coalesce("_work", F.lit(0))
    number = F.lit(0).cast("long")
    for digit, bound in zip((work, F.coalesce("_refused", F.lit(0)), ((work == 0) & F.col("bare")).cast("int"), F.col("terms")), _radix(limits), strict=True):
        number = number * bound + digit
    own = F.concat_ws(" ", number.cast("string"), "id")
    out = entries.join(led.hint("merge"), F.col("id") == F.col("at"), "left").withColumn("all", F.when(F.col("_led").isNull(), F.array(own)).otherwise(F.array_distinct(F.concat(F.array(own), "_led"))))
    whole = F.coalesce("_whole", F.lit(True)) & (work < limits.visits) & (F.size("all") <= limits.elements) & F.coalesce(F.col("terms") <= limits.terminals, F.lit(False))
    return out.select("id", whole.alias("whole"), F.when(whole, F.col("all")).alias("all"))


def totals(elements: DataFrame, relations: DataFrame, seeds: DataFrame, direction: str = "forward", limits: Limits = Limits(), plain: bool = False) -> DataFrame:
    """What the slices of the seeds come to, without their order: seed, elements (ids in order), relations, terminals, gaps, work and ``truncated``.

    Where no budget binds, a slice is all that its seed leads to, in whatever order it is taken, so joins find it without a loop.  The distinct elements are layered
    by their hops from the nearest seed; where moves lead from a layer to the next one only, what an element leads to is put together from the deepest layer
    up, once for all seeds that meet it, and a move is joined once.  It comes with what each element adds to the sums, so elements met twice count once.
    Seeds that are unknown, that lead to a move within a layer or back to an earlier one, or whose budgets bind are left to ``slices``.

    With ``plain`` an element is known to be one row, and relations to be named by their ends: two of equal ends are equal rows.  Elements are then taken as
    they are, and repeated relations are dropped where they are laid out, without their ids.
    """
    spark = seeds.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = seeds.filter("id is not null").select("id").distinct()
    radix = _radix(limits)
    if direction == "both" or limits.stop_at_terminal or limits.stop_at_boundary or prod(radix) >= 2**63:
        return _counted(slices(elements, relations, names, direction, limits))
    one = elements.filter("id is not null")
    if not plain:
        one = one.repartition(n, "id").groupBy("id").agg(F.min(F.struct("priority", "place", "status", "boundary", "origin", "terminals")).alias("e")).select("id", "e.*")
    shut = F.coalesce(F.col("boundary").isin(*limits.closed), F.lit(False)) | F.coalesce(F.col("status") == "unsupported", F.lit(False))
    terms = F.coalesce(F.size("terminals"), F.lit(0))
    known = stored_by(one.select("id", (~shut).alias("enter"), (~F.coalesce("origin", F.lit(False)) & (terms == 0)).alias("bare"), terms.alias("terms")), ["id"], "elements", dealt=not plain)
    start = stored_by(names, ["id"], "seeds")
    ok = F.coalesce(F.col("status").isin(*ACCEPTED), F.lit(False)).alias("ok")
    rows = _oriented(relations, direction).select("at", "to", ok).repartition(n, "at").distinct() if plain else edges(relations, direction).select("at", "to", ok).repartition(n, "at")
    rows = rows.join(start.select(F.col("id").alias("_seed")).hint(_by(start.count(), n)), F.col("at") == F.col("_seed"), "left")
    moves = stored(rows.select("at", "to", "ok", F.col("_seed").isNotNull().alias("first")), "edges")
    rest = stored_by(moves.filter("not first").drop("first"), ["at"], "rest")

    layers, seen, front = [], [], moves.filter("first").drop("first")
    while True:  # layer by layer, what the moves lead to
        to = front.filter("ok").select(F.col("to").alias("_end")).distinct()
        found = to.join(known.hint("merge"), F.col("_end") == F.col("id"), "left").select("_end", F.coalesce("enter", F.lit(False)).alias("enter"), "bare", "terms")
        met = F.lit(False)
        for i, before in enumerate([start, reduce(DataFrame.union, seen)] if seen else [start]):
            found = found.join(before.select(F.col("id").alias(f"_met{i}")).hint("merge"), F.col("_end") == F.col(f"_met{i}"), "left")
            met = met | F.col(f"_met{i}").isNotNull()
        nodes = stored_by(found.select(F.col("_end").alias("id"), (F.col("enter") & ~met).alias("new"), "enter", "bare", "terms"), ["id"], "nodes")
        layers.append((front, nodes))
        new = nodes.filter("new").select("id", "bare", "terms")
        if len(layers) > limits.depth or new.isEmpty():
            break
        seen.append(new.select("id"))
        front = rest.join(new.select(F.col("id").alias("_at")).hint("merge"), F.col("at") == F.col("_at"), "left_semi")

    closed, ends = None, []
    for i in range(len(layers) - 1, -1, -1):  # and up again
        front, nodes = layers[i]
        if closed is None:  # what can be entered here has been met before, or lies too deep
            whole = nodes.withColumn("whole", F.lit(False)).withColumn("all", F.lit(None).cast("array<string>"))
        else:
            whole = nodes.join(closed.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left")
        whole = _stored_sorted(whole.select(F.col("id").alias("_end"), "enter", F.coalesce("whole", F.lit(False)).alias("_whole"), F.col("all").alias("_all")), "ends")
        ends.append(whole)
        entries = layers[i - 1][1].filter("new").select("id", "bare", "terms") if i else start.join(known.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left").select("id", "bare", "terms")
        closed = _closed(entries, front, F.broadcast(whole) if whole.count() <= FEW_NAMES else whole.hint(_by(10 * whole.count(), n)), limits)

    number = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.substring_index(x, " ", 1).cast("long"))
    ids = F.array_sort(F.transform("all", lambda x: F.substr(x, F.instr(x, " ") + 1)))
    out = closed.select(F.col("id").alias("seed"), ids.alias("elements"), number.alias("_sum"), "whole")
    work, refused, lone, terminals = (_digit(F.col("_sum"), radix, i).cast("int") for i in range(4))
    out = out.select("seed", "elements", (work - refused).alias("relations"), terminals.alias("terminals"), (refused + lone).alias("gaps"), work.alias("work"), "whole")
    fits = F.col("whole") & (F.col("work") < limits.visits) & (F.col("relations") <= limits.relations) & (F.col("terminals") <= limits.terminals) & (F.col("gaps") <= limits.gaps)
    out = _stored_sorted(out.withColumn("whole", fits), "totals")
    release(moves, rest, start, known, *(nodes for _, nodes in layers), *ends)
    left = out.filter("not whole").select(F.col("seed").alias("id"))
    done = out.filter("whole").drop("whole").withColumn("truncated", F.array().cast("array<string>"))
    return done if left.isEmpty() else done.unionByName(_counted(slices(elements, relations, left, direction, limits)))


def _stored_sorted(rows: DataFrame, label: str) -> DataFrame:
    conf = rows.sparkSession.conf
    before = conf.get(OBJECT_HASH, "true")
    conf.set(OBJECT_HASH, "false")
    try:
        return stored(rows, label)
    finally:
        conf.set(OBJECT_HASH, before)


def _counted(out: DataFrame) -> DataFrame:
    """Slices as their totals."""
    size = {c: F.size(c) for c in ("relations", "terminals", "gaps")}
    return out.select("seed", F.array_sort("elements.id").alias("elements"), *[x.alias(c) for c, x in size.items()], "work", "truncated")


def _with_gaps(out: DataFrame, gaps: DataFrame, limits: Limits) -> DataFrame:
    """GRF-24: add the gaps that start in a slice, in the order of its elements and of their ids, up to the bound."""
    out = stored(out, "slices")
    own = gaps.select("id", F.col("src").alias("_src"), "dst", "reason").filter("_src is not null")
    own = own.withColumn("_k", F.row_number().over(W.partitionBy("_src").orderBy("id"))).filter(F.col("_k") <= limits.gaps + 1)
    at = out.select("seed", F.size("gaps").alias("_used"), F.transform("elements", lambda e: e["id"]).alias("_ids"), F.posexplode("elements.id").alias("_n", "_id"))
    met = at.join(own, F.col("_id") == F.col("_src"))
    met = met.withColumn("_place", F.row_number().over(W.partitionBy("seed").orderBy("_n", "_k"))).filter(F.col("_place") + F.col("_used") <= limits.gaps + 1)
    inside = F.when(F.array_contains("_ids", F.col("dst")), F.col("dst"))
    more = met.groupBy(F.col("seed").alias("_seed")).agg(
        F.array_sort(F.collect_list(F.when(F.col("_place") + F.col("_used") <= limits.gaps, F.struct("_place", F.col("_src").alias("src"), inside.alias("dst"), "reason", F.col("id").alias("cause"))))).alias("_more"),
        F.max(F.col("_place") + F.col("_used") > limits.gaps).alias("_over"),
    )
    joined = out.join(more, F.col("seed") == F.col("_seed"), "left")
    added = F.transform(F.coalesce("_more", F.array()), lambda g: F.struct(g["src"].alias("src"), g["dst"].alias("dst"), g["reason"].alias("reason"), g["cause"].alias("cause")))
    flagged = F.when(F.coalesce("_over", F.lit(False)), F.array_sort(F.array_union("truncated", F.array(F.lit("gaps"))))).otherwise(F.col("truncated"))
    return joined.withColumn("gaps", F.concat("gaps", F.when(F.col("_more").isNotNull(), added).otherwise(F.slice("gaps", 1, 0)))).withColumn("truncated", flagged).drop("_seed", "_more", "_over")


def _arrow_schema(spark, schema: str) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
