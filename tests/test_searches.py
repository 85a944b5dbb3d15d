"""Searches with states against plain loops: field lineage, bounded slices, unique paths, unfolded trees, layouts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sinkwell.operators import layout, lineage, slices, unique
from sinkwell.operators.unfold import unfold
from sinkwell.operators.unique import unique_search
from sinkwell.sources import markup

# ---------------------------------------------------------------- field lineage

STARTS = "origin string, id string, field array<string>"
RELATIONS = "src string, dst string, kind string, segment string, status string"


def plain_lineage(starts, relations, gaps, most):
    """States by a queue, stops of every state."""
    rel = set(relations)
    out_of = {}
    for r in rel:
        out_of.setdefault(r[0], []).append(r)
    least = {}
    for i, src in gaps:
        if src is not None:
            least[src] = min(i, least.get(src, i))

    def refused(r):
        src, dst, kind, segment, status = r
        if status != "proven":
            return "partial-proof"
        if kind not in ("alias", "argument", "return", "result", "wrap", "read"):
            return "unsupported-relation"
        if kind in ("argument", "return") and len({x[1] for x in rel if x[0] == src and x[2] == kind and x[4] == "proven"}) > 1:
            return "ambiguous-target"
        if kind == "result" and len({x[0] for x in rel if x[1] == dst and x[2] == kind and x[4] == "proven"}) > 1:
            return "multiple-origins"
        return "dynamic-index" if kind in ("wrap", "read") and segment is None else None

    hops = {(o, i, tuple(f)): 0 for o, i, f in starts if i is not None and f is not None}
    queue, rows = list(hops), set()
    while queue:
        state = origin, at, field = queue.pop(0)
        rows.add((origin, at, field, None, None, least.get(at), hops[state]))
        for r in out_of.get(at, []) if at not in least else []:
            _, dst, kind, segment, _ = r
            stop, after = refused(r), field
            if stop is None and kind == "wrap":
                stop, after = ("budget-exhausted", None) if len(field) >= most else (None, (segment, *field))
            elif stop is None and kind == "read":
                stop, after = (None, field[1:]) if field[:1] == (segment,) else ("field-mismatch", None)
            if stop:
                rows.add((origin, at, field, stop, dst, None, hops[state]))
            elif (origin, dst, after) not in hops:
                hops[origin, dst, after] = hops[state] + 1
                queue.append((origin, dst, after))
    return rows


def lineage_rows(spark, starts, relations, gaps=(), most=4):
    known = spark.createDataFrame(list(gaps), "id string, src string") if gaps else None
    out = lineage.field_lineage(spark.createDataFrame(starts, STARTS), spark.createDataFrame(relations, RELATIONS), known, most)
    return out, {(r.origin, r.id, tuple(r.field), r.stop, r.target, r.gap, r.hop) for r in out.collect()}


def test_a_field_goes_through_wraps_and_reads_over_many_hops(spark):
    chain = [(f"v{i}", f"v{i + 1}", "wrap" if i < 6 else "read", f"s{i if i < 6 else 11 - i}", "proven") for i in range(12)]
    _, rows = lineage_rows(spark, [("a", "v0", ["x"])], chain, most=9)
    assert ("a", "v6", ("s5", "s4", "s3", "s2", "s1", "s0", "x"), None, None, None, 6) in rows
    assert ("a", "v12", ("x",), None, None, None, 12) in rows and len(rows) == 13


def test_cycles_end_where_the_stack_is_full_or_the_state_is_known(spark):
    grow = [("a", "b", "wrap", "s", "proven"), ("b", "a", "alias", None, "proven")]
    _, rows = lineage_rows(spark, [("o", "a", [])], grow, most=3)
    assert ("o", "a", ("s", "s", "s"), "budget-exhausted", "b", None, 6) in rows and len(rows) == 8
    level = [("a", "b", "wrap", "s", "proven"), ("b", "a", "read", "s", "proven")]
    _, rows = lineage_rows(spark, [("o", "a", [])], level)
    assert rows == {("o", "a", (), None, None, None, 0), ("o", "b", ("s",), None, None, None, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_lineage_equals_a_plain_loop_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    kinds = ["alias", "argument", "return", "result", "wrap", "wrap", "read", "read", "opaque", None]
    node = lambda: f"v{rng.randrange(14)}"
    relations = [(node(), node(), rng.choice(kinds), rng.choice(["s", "t", None]), rng.choice(["proven"] * 5 + ["partial", None])) for _ in range(45)]
    relations += relations[:4]
    starts = [(o, node(), [rng.choice("st")] * rng.randrange(3)) for o in ("a", "b", "c", None) for _ in range(2)] + [("d", None, ["s"]), ("d", "v1", None)]
    gaps = [("g2", "v3"), ("g1", "v3"), ("g3", "v5"), ("g4", None)]
    out, rows = lineage_rows(spark, starts + starts, relations, gaps)
    assert rows == plain_lineage(starts, relations, gaps, 4)
    assert out.count() == len(rows)
    stopped = sorted((r for r in rows if r[5]), key=lambda r: (r[0] is not None, r[0] or "", r[2], r[1]))
    got = lineage.frontiers(out, 3).collect()
    assert [(r.origin, r.id, tuple(r.field), r.gap) for r in got] == [(r[0], r[1], r[2], r[5]) for r in stopped[:3]]
    per = lineage.frontiers(out, 1, by="origin").collect()
    assert {r.origin for r in per} == {r[0] for r in stopped} and len(per) == len({r[0] for r in stopped})


def test_a_level_of_lineage_exchanges_its_own_states_only(spark, monkeypatch):
    plans = []

    def kept(df, keys, label, stored_by=lineage.stored_by, **how):
        if how.get("dealt"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored_by(df, keys, label, **how)

    monkeypatch.setattr(lineage, "stored_by", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        starts = [("s0", "s0", ["x"]), (None, "s0", ["x"]), (None, "s0", ["x"])]
        _, got = lineage_rows(spark, starts, [(f"s{i}", f"s{(i + 1) % 11}", "alias", None, "proven") for i in range(11)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 22  # more levels than tables of known states, which become one
    assert len(plans) == 11 and all(p.count("Exchange") == 2 for p in plans)


def test_lineage_without_rows(spark):
    assert lineage_rows(spark, [("o", "a", ["x"])], [])[1] == {("o", "a", ("x",), None, None, None, 0)}
    assert lineage_rows(spark, [(None, None, None)], [])[1] == set()


# ---------------------------------------------------------------- slices

ELEMENTS = "id string, priority int, place string, status string, boundary string, origin boolean, terminals array<string>"


def plain_slice(elements, relations, seed, direction, limits, gaps=()):
    """One queue, popped by scanning for the first of the highest priority."""
    by_id = {e[0]: e for e in elements}
    out = {"elements": [], "relations": [], "terminals": [], "gaps": [], "work": 0, "truncated": set()}
    depth, keys, queue = {}, [], []
    cap = max(16, min(256, limits.relations))

    def gap(*key):
        if key not in keys:
            if len(keys) == cap:
                out["truncated"].add("gaps")
            else:
                keys.append(key)

    def take(name, d):
        if name in depth:
            return True
        if len(depth) == limits.elements:
            out["truncated"].add("elements")
            gap(seed, name, "budget-exhausted", "elements")
            return False
        depth[name] = d
        roles = by_id[name][6]
        for role in roles:
            if len(out["terminals"]) == limits.terminals:
                out["truncated"].add("terminals")
                gap(name, None, "budget-exhausted", "terminals")
            else:
                out["terminals"].append((name, role))
        if not (roles and limits.stop_at_terminal):
            queue.append(name)
        return True

    if seed not in by_id:
        gap(seed, None, "disconnected", "unknown seed")
    else:
        take(seed, 0)
    going = True
    while queue and going:
        best = max(by_id[q][1] for q in queue)
        name = next(q for q in queue if by_id[q][1] == best)
        queue.remove(name)
        moves = []
        for i, s, t, status in relations:
            if direction != "backward" and s == name:
                moves.append((i, t, status))
            elif direction != "forward" and t == name:
                moves.append((i, s, status))
        moves.sort(key=lambda m: (-by_id[m[1]][1] if m[1] in by_id else 0, m[1] not in by_id, by_id[m[1]][2] if m[1] in by_id else "", m[1], m[0]))
        if out["work"] >= limits.visits:
            out["truncated"].add("work")
            gap(name, None, "budget-exhausted", "work")
            break
        if not moves and not by_id[name][5] and not by_id[name][6]:
            gap(name, None, "disconnected", "no relation")
        for i, to, status in moves:
            if out["work"] >= limits.visits:
                out["truncated"].add("work")
                gap(name, to, "budget-exhausted", "work")
                going = False
                break
            out["work"] += 1
            e = by_id.get(to)
            if e is None:
                gap(name, to, "unproven-handoff", i)
            elif e[4] in limits.closed:
                gap(name, to, "unsupported-boundary", i)
            elif status not in ("proven", "partial") or e[3] == "unsupported":
                gap(name, to, "unproven-handoff", i)
            elif depth[name] >= limits.depth and to not in depth:
                out["truncated"].add("depth")
                gap(name, to, "budget-exhausted", "depth")
            elif len(out["relations"]) >= limits.relations and i not in out["relations"]:
                out["truncated"].add("relations")
                gap(name, to, "budget-exhausted", "relations")
            elif take(to, depth[name] + 1):
                if i not in out["relations"]:
                    out["relations"].append(i)
                if e[4] is not None and limits.stop_at_boundary:
                    gap(to, None, "unsupported-boundary", "stop")
                    queue[:] = [q for q in queue if q != to]
    if "work" in out["truncated"] and queue:
        gap(queue[0], None, "budget-exhausted", "work left")
    for name in depth:
        for i, s, t, reason in sorted(g for g in gaps if g[1] == name):
            gap(s, t, reason, i)
    inside = lambda x: x if x in depth else None
    out["gaps"] = [(inside(s), inside(t), r, c) for s, t, r, c in keys]
    out["elements"] = list(depth.items())
    return out


def evidence(rng, n, m):
    elements = [
        (f"e{i:03}", rng.choice([0, 0, 80, 2000, 3000, 4000]), f"f{rng.randrange(5)}", rng.choice(["proven"] * 6 + ["unsupported"]), rng.choice([None] * 4 + ["external-code", "unknown"]), rng.random() < 0.1, rng.sample(["render", "stdout"], rng.choice([0, 0, 0, 1, 2])))
        for i in range(n)
    ]
    end = lambda: f"e{rng.randrange(n + 2):03}"  # noqa: E731  (two of them are unknown)
    relations = [(f"r{i:04}", end(), end(), rng.choice(["proven"] * 5 + ["partial", "unsupported"])) for i in range(m)]
    gaps = [(f"g{i:03}", end(), rng.choice([end(), None]), "ambiguous-target") for i in range(n)]
    return elements, relations, gaps


CASES = {
    "elements": slices.Limits(elements=7),
    "relations": slices.Limits(relations=9),
    "terminals": slices.Limits(terminals=2),
    "work": slices.Limits(work=13),
    "depth": slices.Limits(depth=2),
    "gaps": slices.Limits(relations=16, elements=60),
    "none": slices.Limits(elements=1000, relations=1000, terminals=1000),
    "stops": slices.Limits(stop_at_terminal=True, stop_at_boundary=True, closed=("unknown",)),
}


@pytest.mark.parametrize("direction,names", [("forward", ["elements", "relations", "terminals", "work", "depth"]), ("backward", ["stops"]), ("both", ["gaps", "none"])])
def test_slices_equal_a_plain_loop_with_every_budget_binding(spark, direction, names):
    rng = random.Random(5)
    elements, relations, gaps = evidence(rng, 50, 110)
    frames = spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(relations + relations[:3], "id string, src string, dst string, status string")
    seeds = [e[0] for e in elements[::2]] + ["nobody"]
    for name in names:
        limits = CASES[name]
        out = slices.slices(*frames, spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "id string"), direction, limits, spark.createDataFrame(gaps, "id string, src string, dst string, reason string"))
        got, bound = {r.seed: r for r in out.collect()}, False
        assert set(got) == set(seeds)
        for s in seeds:
            want, r = plain_slice(elements, relations, s, direction, limits, gaps), got[s]
            assert [tuple(e) for e in r.elements] == want["elements"], (name, s)
            assert r.relations == want["relations"] and [tuple(t) for t in r.terminals] == want["terminals"], (name, s)
            assert [tuple(g) for g in r.gaps] == want["gaps"] and r.work == want["work"], (name, s)
            assert set(r.truncated) == want["truncated"], (name, s)
            bound |= name in want["truncated"]
        assert bound or name in ("none", "stops")


def test_a_used_up_budget_is_marked_only_if_something_was_left_out(spark):
    elements = [(x, 0, x, "proven", None, True, []) for x in "abc"]
    chain = spark.createDataFrame([("1", "a", "b", "proven"), ("2", "b", "c", "proven")], "id string, src string, dst string, status string")
    run = lambda **k: slices.slices(spark.createDataFrame(elements, ELEMENTS), chain, spark.createDataFrame([("a",)], "id string"), limits=slices.Limits(**k)).first().truncated
    assert run(elements=3) == [] and run(elements=2) == ["elements"]
    assert run(depth=2) == [] and run(depth=1) == ["depth"]
    with pytest.raises(ValueError):
        slices.Limits(depth=0)


def test_loops_run_once_where_no_budget_binds(spark, monkeypatch):
    elements = [(f"e{i}", 0, f"e{i}", "proven", None, True, []) for i in range(6)]
    chain = spark.createDataFrame([(str(i), f"e{i}", f"e{i + 1}", "proven") for i in range(5)], "id string, src string, dst string, status string")
    seeds = spark.createDataFrame([(e[0],) for e in elements], "id string")
    labels, stored = [], slices.stored
    monkeypatch.setattr(slices, "stored", lambda df, label: labels.append(label) or stored(df, label))
    got = {r.seed: [(e.id, e.depth) for e in r.elements] for r in slices.slices(spark.createDataFrame(elements, ELEMENTS), chain, seeds).collect()}
    assert got == {f"e{i}": [(f"e{j}", j - i) for j in range(i, 6)] for i in range(6)}
    assert labels.count("slices") == 1


def plain_totals(elements, relations, seed, direction, limits):
    s = plain_slice(elements, relations, seed, direction, limits)
    return sorted(e for e, _ in s["elements"]), *(len(s[c]) for c in ("relations", "terminals", "gaps")), s["work"], sorted(s["truncated"])


RELATIONS = "id string, src string, dst string, status string"


def totals_of(spark, elements, relations, seeds, direction, limits, **more):
    frames = spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(relations, RELATIONS), spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "id string")
    rows = slices.totals(*frames, direction, limits, **more).collect()
    assert len(rows) == len(seeds)
    return {r.seed: (r.elements, r.relations, r.terminals, r.gaps, r.work, r.truncated) for r in rows}


@pytest.mark.parametrize("direction,name", [("forward", "terminals"), ("backward", "depth"), ("both", "none")])
def test_totals_of_any_graph_equal_a_plain_loop(spark, direction, name):
    elements, relations, _ = evidence(random.Random(9), 40, 60)
    seeds = [e[0] for e in elements[::5]] + ["nobody"]
    got = totals_of(spark, elements, relations + relations[:3], seeds, direction, CASES[name])
    assert got == {s: plain_totals(elements, relations, s, direction, CASES[name]) for s in seeds}


def test_totals_run_no_loop_where_no_budget_binds(spark, monkeypatch):
    asked, loops = [], slices.slices
    monkeypatch.setattr(slices, "slices", lambda e, r, s, *more: asked.extend(x.id for x in s.collect()) or loops(e, r, s, *more))
    kinds = {"a": 6, "b": 8, "c": 4, "d": 2}
    rng = random.Random(2)
    elements = [(f"{k} {i}", 0, f"{k}{i}", "unsupported" if (k, i) == ("b", 1) else "proven", "shut" if (k, i) == ("c", 1) else None, k == "d" and i == 0, ["x", "y"][: i % 3] if k in "bc" else []) for k, n in kinds.items() for i in range(n)]
    relations = []
    for k, to in ("ab", "bc", "cd"):
        for i in range(kinds[k]):
            for j in rng.sample(range(kinds[to] + (to == "b")), 2):  # b 8 is unknown
                relations.append((f"{k}{i}>{to}{j}", f"{k} {i}", f"{to} {j}", rng.choice(["proven", "partial", "proven", None, "unsupported"])))
    elements += [(f"b 9{i}", 0, "", "proven", None, True, []) for i in range(40)]
    relations += [(f"many{i}", "a 5", f"b 9{i}", "proven") for i in range(40)]  # binds
    several = [*relations, ("again", *relations[0][1:3], "proven")]
    seeds, limits = [f"a {i}" for i in range(6)], slices.Limits(relations=30, elements=20, closed=("shut",))
    for rows, plain in ((several, False), (relations, True)):
        got = totals_of(spark, elements if plain else elements + elements[:3], rows + rows[:5], seeds, "forward", limits, plain=plain)
        assert got == {s: plain_totals(elements, rows, s, "forward", limits) for s in seeds}
    assert asked == ["a 5"] * 2 and got["a 5"][-1] and max(v[0][-1] for v in got.values()) > "d"


def test_backward_slices_of_the_star_run_no_loop(spark, small, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(slices, "slices", None)
    assert e.queries()["grf4_backward_slices"](spark, small).count() == spark.read.parquet(f"{small}/orders.parquet").count()


def test_slices_of_nothing(spark):
    none = spark.createDataFrame([], ELEMENTS)
    rel = spark.createDataFrame([], "id string, src string, dst string, status string")
    row = slices.slices(none, rel, spark.createDataFrame([("a",)], "id string")).first()
    assert row.elements == [] and [g.reason for g in row.gaps] == ["disconnected"]
    assert slices.slices(none, rel, spark.createDataFrame([], "id string")).collect() == []


# ---------------------------------------------------------------- layout


def test_a_step_exchanges_the_front_only_and_splits_hot_starts(spark):
    edges = spark.createDataFrame([("hot", f"d{i}") for i in range(500)] + [("a", "b"), ("c", "d")], "src string, dst string")
    front = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "at string, n int")
    want = [("hot", 1, f"d{i}") for i in range(500)] + [("a", 2, "b")]
    for chunk in (50, 1000):
        ways = layout.Layout(edges, chunk)
        assert ways.split == (chunk == 50)
        assert sorted((r["at"], r["n"], r["dst"]) for r in ways.step(front, "at").collect()) == sorted(want)
        left = ways.step(front, "at", "left").collect()
        assert sorted((r["at"], r["n"], r["dst"]) for r in left if r["dst"]) == sorted(want)
        assert [(r["at"], r["n"]) for r in left if not r["dst"]] == [("z", 3)]
        if ways.split:
            sizes = [r["n"] for r in ways.edges.filter("src = 'hot'").groupBy("_piece").agg(F.count("*").alias("n")).collect()]
            assert len(sizes) == 10 and max(sizes) < 100
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = ways.step(front, "at")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        scan = plan[plan.index("Bucketed: true") - 400 :] if "Bucketed: true" in plan else ""
        assert scan and plan.count("Exchange") == (3 if ways.split else 1)
        ways.release()


def test_rows_that_crowd_at_one_start_meet_its_edges_beside_the_buckets(spark):
    edges = spark.createDataFrame([("busy", "x"), ("busy", "y"), ("busy", "x"), ("a", "b"), ("hot", "h")] + [("hot", f"h{i}") for i in range(60)], "src string, dst string")
    front = spark.createDataFrame([("busy", i) for i in range(200)] + [("hot", i) for i in range(30)] + [("a", 0), ("end", 1)] + [("far", i) for i in range(90)], "at string, n int")
    want = sorted([("busy", i, d) for i in range(200) for d in "xy"] + [("hot", i, h) for i in range(30) for h in ["h", *(f"h{j}" for j in range(60))]] + [("a", 0, "b")])
    ways = layout.Layout(edges, 25)
    taken = []
    met = ways._met
    ways._met = lambda rows, at, how: taken.append((at, {r[at] for r in rows.collect()})) or met(rows, at, how)
    for how in ("inner", "left"):
        rows = [(r["at"], r["n"], r["dst"]) for r in ways.step(front, "at", how, crowded=True).collect()]
        assert sorted(r for r in rows if r[2]) == want
        assert sorted(r[:2] for r in rows if not r[2]) == (sorted([("end", 1)] + [("far", i) for i in range(90)]) if how == "left" else [])
    assert taken == [("_busy", {"busy", "hot", "far"}), ("at", {"a", "end"})] * 2


# ---------------------------------------------------------------- unique paths


def search(spark, edges, origins, ends, **bounds):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    rows = unique_search(spark.createDataFrame(edges, "src string, dst string"), frame(origins), frame(ends), **bounds).collect()
    return {(r.origin, r.end): (r.result, r.path) for r in rows}


def plain_paths(edges, origin, ends):
    """All simple paths that end at their first end."""
    found, stack = {}, [[origin]]
    while stack:
        path = stack.pop()
        for a, b in set(edges):
            if a == path[-1] and b not in path:
                if b in ends:
                    found.setdefault((origin, b), []).append([*path, b])
                else:
                    stack.append([*path, b])
    return found


def test_forty_levels_answer_at_once_though_their_paths_are_2_to_the_40(spark):
    edges = [(f"{x}{i}", f"{y}{i + 1}") for i in range(1, 40) for x in "ab" for y in "ab"] + [("start", "a1"), ("start", "b1"), ("a40", "end"), ("b40", "end"), ("start", "near"), ("near", "only")]
    began = time.time()
    got = search(spark, edges, ["start"], ["end", "only"], most_hops=60)
    assert got == {("start", "end"): ("several", None), ("start", "only"): ("unique", ["start", "near", "only"])}
    assert time.time() - began < 240
    assert search(spark, edges, ["start"], ["end", "only"], most_hops=3) == {("start", "only"): ("exhausted", None), ("start", None): ("exhausted", None)}
    assert search(spark, edges, ["start"], ["end", "only"], most_states=5)[("start", None)] == ("exhausted", None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_search_never_errs_on_graphs_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for _ in range(rng.choice([11, 14, 18]))]
    edges += [(f"v{rng.randrange(9)}", f"e{rng.randrange(3)}") for _ in range(5)] + edges[:2]
    origins, ends = ["v0", "v1", "v2", "nowhere"], ["e0", "e1", "e2"]
    got = search(spark, edges, origins, ends)
    for o in origins:
        want, lost = plain_paths(edges, o, ends), (o, None) in got
        for e in ends:
            paths, result = want.get((o, e), []), got.get((o, e))
            if result is None:
                assert not paths or lost
            elif result[0] == "unique":
                assert paths == [result[1]]
            elif result[0] == "several":
                assert len(paths) > 1
            else:
                assert lost
    assert any(r[0] == "unique" for r in got.values())


def test_a_level_of_unique_paths_is_exchanged_once_after_its_step(spark, monkeypatch):
    plans = []

    def kept(df, label, stored=unique.stored):
        if label == "paths":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(unique, "stored", kept)
    got = search(spark, [("a", "b"), ("b", "e"), ("a", "c"), ("c", "d"), ("d", "f"), ("a", "b")], ["a"], ["e", "f"])
    assert got == {("a", "e"): ("unique", ["a", "b", "e"]), ("a", "f"): ("unique", ["a", "c", "d", "f"])}
    later = [p.count("Exchange hashpartitioning(origin") for p in plans[1:]]  # the first level also makes its origins distinct
    assert later and set(later) == {1}


# ---------------------------------------------------------------- unfolding


def plain_unfold(uses, root, most):
    rows, queued, queue, truncated = [(None, root, None, 0, False, True)], [root], [(root, [])], False
    while queue:
        if len(queued) > most:
            truncated = True
            break
        at, above = queue.pop(0)
        for src, dst, pos in sorted(set(uses), key=lambda u: u[2]):
            if src != at:
                continue
            again = dst == at or dst in above
            first = not again and dst not in queued
            if first:
                queued.append(dst)
                queue.append((dst, [*above, at]))
            rows.append((at, dst, pos, len(above) + 1, again, first))
    return sorted((*r, truncated) for r in rows if r[0]), len(queued)


def test_unfolding_marks_recursion_and_stops_at_the_bound(spark):
    rng = random.Random(9)
    uses = [("A", "B", 1), ("B", "A", 2), ("B", "B", 3), ("A", "C", 4), ("C", "D", 5), ("B", "D", 6), ("D", "A", 7)]
    uses += [(f"n{i}", f"n{rng.randrange(40)}", 100 + 3 * i + j) for i in range(40) for j in range(3)] + [("A", "n0", 8), ("n39", "A", 9)]
    frame = spark.createDataFrame(uses + uses[:3], "src string, dst string, pos int")
    for most in (5000, 12):
        got = unfold(frame, spark.createDataFrame([("A",), ("n5",), ("alone",), (None,), ("A",)], "id string"), most).collect()
        for root in ("A", "n5", "alone"):
            mine = [r for r in got if r.root == root]
            assert [(r.parent, r.depth) for r in mine if r.parent is None] == [(None, 0)]
            want, _ = plain_unfold(uses, root, most)
            assert sorted((r.parent, r.id, r.pos, r.depth, r.recursive, r.first, r.truncated) for r in mine if r.parent) == want
        assert {r.root for r in got} == {"A", "n5", "alone"}


# ---------------------------------------------------------------- trees of pages


def test_ancestors_of_a_tree_a_thousand_deep(spark):
    deep = "".join(f"<div><p{i % 7}>" for i in range(1000)) + "</div>" * 1000 + "<ul><li>x<li><div>"
    pages = spark.createDataFrame([(1, deep), (2, ""), (3, None), (4, "</div><div><a></div></div><ul>")], "page_id long, html string")
    spans = markup.intervals(pages, {"divs": ("div",)})
    rows = {(r.page_id, r.pos): r for r in spans.collect()}
    parents = {(r.page_id, r.pos): r.parent for r in markup.elements(pages).collect()}
    assert set(rows) == set(parents)
    chains, held, divs = {}, dict.fromkeys(rows, 0), dict.fromkeys(rows, 0)
    for page, pos in rows:
        at, chain = parents[page, pos], []
        while at is not None:
            chain.append(at)
            held[page, at] += 1
            divs[page, at] += rows[page, pos].tag == "div"
            at = parents[page, at]
        chains[page, pos] = sorted(chain)
    assert {k: (r.inside, r.divs) for k, r in rows.items()} == {k: (held[k], divs[k]) for k in rows}
    got = {}
    for r in markup.ancestors(spans, spans, 16).select("page_id", "pos", "by.pos").toDF("page", "pos", "by").collect():
        got.setdefault((r.page, r.pos), []).append(r.by)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in chains.items() if v}
    assert max(map(len, chains.values())) == 1000


# ---------------------------------------------------------------- relations by producing file

FACTS = "id string, file string, kind string, symbol string, owner_id string, definition_id string"


def test_relations_are_read_from_the_files_that_can_emit_them(spark, tmp_path):
    from sinkwell.sources.relations import RelationStore, relation_files

    rng = random.Random(8)
    kinds = ["value", "call", "fetch-input", "http-response"]
    facts = [(f"e{i}", f"f{rng.randrange(30)}.ts", rng.choice(kinds[: 4 if i % 9 == 0 else 2]), rng.choice([None, f"s{rng.randrange(20)}"]), rng.choice([None, f"e{rng.randrange(60)}"]), rng.choice([None, f"e{rng.randrange(60)}"])) for i in range(60)]
    elements, by_id = spark.createDataFrame(facts, FACTS), {f[0]: f for f in facts}
    edge = {f[1] for f in facts if f[2] in kinds[2:]}

    def files(i):
        near = [by_id[x] for x in (i, by_id[i][4], by_id[i][5]) if x in by_id]
        symbols = {f[3] for f in near if f[3]}
        return {f[1] for f in near} | {f[1] for f in facts if f[3] in symbols} | (edge if by_id[i][2] in kinds[2:] else set())

    asked = spark.createDataFrame([("e3",), ("e9",), ("e3",), ("unknown",), (None,)], "id string")
    assert {(r.id, r.file) for r in relation_files(elements, asked).collect()} == {(i, f) for i in ("e3", "e9") for f in files(i)}
    relations = [(f"r{k}", f"e{rng.randrange(60)}", f"e{rng.randrange(60)}", "alias", "proven", f"f{rng.randrange(30)}.ts") for k in range(900)]
    store = RelationStore(spark, str(tmp_path / "rel"), groups=16)
    store.write(spark.createDataFrame(relations, "id string, src string, dst string, kind string, status string, producer_file string"))
    one = spark.createDataFrame([("e3",)], "id string")
    for direction, ends in (("forward", (1,)), ("backward", (2,)), ("both", (1, 2))):
        got = sorted(r.relation for r in store.relations_of(elements, one, direction).collect())
        assert got == sorted(r[0] for r in relations if r[5] in files("e3") and any(r[e] == "e3" for e in ends))
    out = store.relations_of(elements, one)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "file_group" in plan[plan.index("PartitionFilters: [") : plan.index("PartitionFilters: [") + 80]
    groups = {r[0] for r in relation_files(elements, one).select(store._group("file")).distinct().collect()}

    def files_read(df):
        df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return scan.metrics().apply("numFiles").value()

    every = files_read(store.read())
    assert files_read(store.read(sorted(groups))) <= len(groups) < every
    assert store.relations_of(elements, asked.filter("id = 'unknown'")).collect() == []
