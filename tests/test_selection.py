"""Greedy selections against the plain loops that define them."""

import random

import pytest
from pyspark.sql import functions as F

from sinkwell.operators import ranking as R

SCHEMA = "seq long, sink_id long, file string, feature string, shape string, pivot string, burden double, queue string, background boolean"


def rows_of(rng, n):
    out = []
    for i in range(n):
        f = rng.randrange(9)
        out.append((i, i, f"src/{f % 3}/{f}.tsx", str(f % 3), f"s{rng.randrange(3)}", rng.choice([None, "p0", "p1", "p2"]), round(rng.random(), 2), "q", rng.random() < 0.3))
    return out


def by_burden(rows):
    return sorted(rows, key=lambda r: (-r[6], r[0]))


def loop_spread(rows, n, per_file, per_feature):
    files, features, out = {}, {}, []
    for r in by_burden(rows):
        if len(out) < n and files.get(r[2], 0) < per_file and features.get(r[3], 0) < per_feature:
            out.append(r[0])
            files[r[2]] = files.get(r[2], 0) + 1
            features[r[3]] = features.get(r[3], 0) + 1
    return out


def loop_diverse(rows, n, weight):
    pool, chosen = by_burden(rows), []
    top = max(0.0001, max(r[6] for r in rows))
    while pool and len(chosen) < n:
        k = len(chosen)

        def value(r):
            if not k:
                return r[6]
            f = sum(c[2] == r[2] for c in chosen) / k
            s = sum(c[4] == r[4] for c in chosen) / k
            p = sum(c[5] == r[5] for c in chosen) / k if r[5] is not None else 0
            return r[6] - weight * top * (0.5 * f + 0.25 * s + 0.25 * p)

        best = max(range(len(pool)), key=lambda i: (value(pool[i]), -i))
        chosen.append(pool.pop(best))
    return [r[0] for r in chosen]


def loop_units(rows, packs):
    files = {}
    for r in by_burden(rows):
        files.setdefault(r[2], []).append(r)
    out = []
    for members in files.values():
        units = []
        for r in members:
            keys = packs.get(r[0], set())
            unit = next((u for u in units if keys & u["keys"] or r[5] is not None and (u["pivot"], u["shape"]) == (r[5], r[4])), None)
            if unit is None:
                unit = {"head": r[0], "keys": set(), "pivot": r[5], "shape": r[4], "n": 0}
                units.append(unit)
            unit["n"] += 1
            unit["keys"] |= keys
        out += [(u["head"], u["n"]) for u in units]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_selections_equal_the_loops(spark, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.seq for r in R.spread(df, 10).collect()) == sorted(loop_spread(rows, 10, 2, 4))
    first = {}
    for r in by_burden(rows):
        first.setdefault(r[2], r[0])
    want = sorted(by_burden(rows), key=lambda r: (first[r[2]] != r[0], -r[6], r[0]))[:12]
    assert sorted(r.seq for r in R.coverage(df, 12).collect()) == sorted(r[0] for r in want)
    for n, weight in ((4, 0.9), (12, 0.5)):
        got = [r.seq for r in R.diverse(df, n, weight).orderBy("place").collect()]
        assert got == loop_diverse(rows, n, weight)
    packs = {i: {f"k{rng.randrange(40)}" for _ in range(rng.randrange(3))} for i in range(150)}
    table = spark.createDataFrame([(i, k) for i, v in packs.items() for k in v], "sink_id long, pack_key string")
    assert sorted((r.seq, r.sinks) for r in R.work_units(df, table).collect()) == loop_units(rows, packs)
    tiers = {r.seq: r.tier for r in R.firsts_first(df, 40).collect()}
    assert {s for s, t in tiers.items() if t == 0} == set(first.values())
    flat = df.withColumn("burden", F.lit(0.0))
    R.CHUNK, before = 7, R.CHUNK
    try:
        assert {r.seq: r.rank for r in R.global_rank(flat, "burden").collect()} == {i: i + 1 for i in range(150)}
    finally:
        R.CHUNK = before
    ranks = {r.seq: r.rank for r in R.global_rank(df, "burden").collect()}
    assert ranks == {r[0]: i for i, r in enumerate(by_burden(rows), 1)}


def test_actionable_pool_keeps_background_only_when_alone(spark):
    rows = spark.createDataFrame(rows_of(random.Random(1), 40), SCHEMA)
    assert R.actionable_pool(rows).filter("background").count() == 0
    alone = rows.withColumn("background", F.lit(True))
    assert R.actionable_pool(alone).count() == 40
    assert R.actionable_pool(rows.limit(0)).count() == 0


def test_nested_sites(spark):
    sites = spark.createDataFrame([("f", 1, 10), ("f", 2, 5), ("f", 11, 12), ("f", 12, 20), ("g", 3, 4)], "file string, start long, end long")
    assert sorted(map(tuple, R.nested_removed(sites).collect())) == [("f", 1, 10), ("f", 11, 12), ("g", 3, 4)]


def loop_nested(sites):
    kept, reach = [], {}
    for f, a, b in sorted(sites, key=lambda s: (s[0] or "", s[1], -s[2])):
        if a > reach.get(f, -1):
            kept.append((f, a, b))
            reach[f] = b
    return kept


def test_nested_sites_over_many_bins(spark, monkeypatch):
    monkeypatch.setattr(R, "SITE_BIN", 7)
    rng = random.Random(4)
    sites = [(rng.choice([None, "f", "g"]), a, a + rng.choice([0, 2, 5, 30])) for a in (rng.randrange(300) for _ in range(200))]
    sites += [("whole", 0, 10_000)] + [("whole", a, a + 3) for a in range(1, 100, 5)]
    got = R.nested_removed(spark.createDataFrame(sites, "file string, start long, end long")).collect()
    order = lambda s: (s[0] or "", s[1], s[2])
    assert sorted(map(tuple, got), key=order) == sorted(loop_nested(sites), key=order)
    assert not R.nested_removed(spark.createDataFrame([], "file string, start long, end long")).collect()


def test_parts_of_a_bin_are_compared_together(spark, monkeypatch):
    sites = [("f", a, a + 3) for a in range(0, 3000, 2)] + [("f", a, a + 6) for a in range(3000, 6000, 10)] + [("f", 7000, None), ("f", 7001, 7003), (None, 5, 6)]
    frame, grouped = spark.createDataFrame(sites, "file string, start long, end long"), []
    group = type(frame).groupBy
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *by: grouped.append((self, by)) or group(self, *by))
    got = R.nested_removed(frame)
    monkeypatch.undo()
    rows, by = grouped[-1]
    assert rows.select("_part").distinct().count() > 300 and rows.select(*by).distinct().count() == 2
    order = lambda s: (s[0] or "", s[1])
    want = [*loop_nested([s for s in sites if s[2] is not None and s[1] < 7000]), ("f", 7000, None), ("f", 7001, 7003)]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_diverse_with_many_files_and_pivots(spark):
    rng = random.Random(8)
    rows = [(i, i, f"f{rng.randrange(60)}", "x", f"s{rng.randrange(2)}", rng.choice([None] + [f"p{j}" for j in range(40)]), rng.randrange(25) / 25, "q", False) for i in range(900)]
    got = R.diverse(spark.createDataFrame(rows, SCHEMA), 5, 0.7).orderBy("place").collect()
    assert [r.seq for r in got] == loop_diverse(rows, 5, 0.7)


def loop_staged(rows, last, caps, total):
    out = []
    for route in sorted({r[0] for r in rows} | set(last), key=str):
        chosen, seen = [], set()
        for stage in sorted(caps):
            for r in sorted((r for r in rows if r[0] == route and r[1] == stage), key=lambda r: (-r[3], r[4])):
                if len(chosen) >= total or sum(c[1] == stage for c in chosen) >= caps[stage]:
                    break
                if (stage, r[2]) not in seen:
                    seen.add((stage, r[2]))
                    chosen.append(r)
        items = [(r[1], r[4]) for r in chosen]
        if route in last:
            items = items[: total - 1] + [(None, last[route])]
        out += [(route, i, *x) for i, x in enumerate(items, 1)]
    return out


def test_staged_choice(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "x", "y", "z"]), rng.randrange(3), i) for i in range(150)]
    last, caps = {"a": 900, "d": 901}, {1: 2, 2: 0, 3: 3}
    schema = "route string, stage int, identity string, score int, item int"
    ends = spark.createDataFrame(list(last.items()), "route string, item int")
    pick = lambda r, total: R.staged_choice(r, ends, "route", "stage", "identity", [F.desc("score"), F.asc("item")], caps, total)
    table = spark.createDataFrame(rows, schema)
    for total in (1, 4, 5, 8):
        got = [tuple(r) for r in pick(table, total).select("route", "place", "stage", "item").collect()]
        assert sorted(got, key=str) == sorted(loop_staged(rows, last, caps, total), key=str)
    assert {tuple(r) for r in pick(table.limit(0), 4).select("route", "place", "item").collect()} == {("a", 1, 900), ("d", 1, 901)}


def test_rounds_of_work_units_shrink(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(*r[:5], None, *r[6:]) for r in rows_of(rng, 200)]
    packs = {i: {f"k{rng.randrange(150)}", "hot" if i % 9 == 0 else f"own{i}"} for i in range(200)}
    table = spark.createDataFrame([(i, k) for i, v in packs.items() for k in v], "sink_id long, pack_key string")
    sizes, before = [], R.stored

    def counted(df, label):
        out = before(df, label)
        if label == "units":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "stored", counted)
    monkeypatch.setattr(R, "RANK_BIN", 7, raising=False)
    assert sorted((r.seq, r.sinks) for r in R.work_units(spark.createDataFrame(rows, SCHEMA), table).collect()) == loop_units(rows, packs)
    assert len(sizes) > 2 and sizes[-1] < sizes[0] / 2


def test_rounds_of_work_units_leave_only_what_is_settled(spark, monkeypatch):
    from pathlib import Path

    from sinkwell.sources.stored import run_dir

    rng = random.Random(6)
    rows = rows_of(rng, 200)
    packs = {i: {f"k{rng.randrange(90)}", "hot" if i % 4 == 0 else f"own{i}"} for i in range(200)}
    table = spark.createDataFrame([(i, k) for i, v in packs.items() for k in [*v, *v]], "sink_id long, pack_key string")
    for most in (3, 1000):  # with keys that are dealt into bins, and without
        monkeypatch.setattr(R, "RANK_BIN", most)
        out, before = R.work_units(spark.createDataFrame(rows, SCHEMA), table), R.stored(spark.range(1), "here")
        assert sorted((r.seq, r.sinks) for r in out.collect()) == loop_units(rows, packs)
        left = [p.name for p in Path(run_dir(spark)).iterdir()]
        assert any(n.startswith("here-") for n in left) and not [n for n in left if n.startswith(("units-", "entries-", "keys-"))]
        R.release(before)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from sinkwell.sources import stored as S

    files = lambda: {f.getPath() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if "shuffle" in f.getName()}
    before, kept = files(), spark.conf.get(S.CLEANUP, None)
    out = R.stored(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n"), "counts")
    end = time.time() + 30
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(S.CLEANUP, None) == kept and out.count() == 1000
    R.release(out)


def test_a_report_in_the_shared_folder_equals_the_persisted_one(spark, small):
    from sinkwell.operators import metrics as M
    from sinkwell.plans.ranked import pivots

    kept, shared = M.Report(spark, small), M.Report(spark, small, shared=True)
    want = {tuple(r) for r in kept.ranked().select("sink_id", "burden", "shape").join(pivots(kept), "sink_id", "left").collect()}
    got = {tuple(r) for r in shared.ranked().select("sink_id", "burden", "shape").join(shared.parts().select("sink_id", "pivot"), "sink_id", "left").collect()}
    packs = {(r.sink_id, f"pack.{r.p}") for r in shared.parts().select("sink_id", F.explode("pack_parts").alias("p")).collect()}
    assert got == want and packs == {tuple(r) for r in kept.packs.collect()}
    shared.close()
    assert not [k for k in shared.__dict__ if k in ("_counted", "_grounded", "_sums", "_packed")]


def test_risks_need_no_roots_but_of_possible_mirrors(spark, small):
    from sinkwell.operators import metrics as M

    r = M.Report(spark, small)
    whole = {x.pack_key: (x.verdict, x.risk) for x in r.pack_groups().collect()}
    assert whole and {f"pack.{x.pack_key}": (x.verdict, x.risk) for x in r._risks().collect()} == whole
    # a mirror object: its roots are counted, of two only one is a prop
    rows = "pack_parts array<long>, label string, category string, defensive_operation_count long, representation_churn long, helper_hops long, reachable_sinks long, sink_id long"
    sinks = spark.createDataFrame([([2, 4], "x={v}", "attribute", 0, 0, 0, 1, 1), ([2, 4], "x={v}", "attribute", 0, 0, 0, 1, 2), ([6, 7], "x={v}", "attribute", 0, 0, 0, 1, 3), ([6, 7], "x={v}", "attribute", 0, 0, 0, 1, 4)], rows)
    r = M.Report(spark, small)
    r.__dict__["_grounded"] = sinks
    got = {x.pack_key: x.verdict for x in r._risks().collect()}
    assert got[2] == got[4] == "mirror-object" and got[6] == got[7] == "cohesive-render-model"


def test_texts_of_steps_come_back_from_their_number(spark, small):
    from sinkwell.sources import star

    got = {r.sink_id: [(s.kind, s.verdict, s.origin, s.guarded, s.guard_key, s.expression) for s in r.steps] for r in star.facts(spark, small).collect()}
    for r in star.items(spark, small).orderBy("sink_id", "item").limit(200).collect():
        assert (r.kind, r.verdict, r.origin, r.guarded, r.guard_key, r.expression) in got[r.sink_id]


def test_equal_guards_of_a_sink_count_once_as_a_sink(spark):
    from sinkwell.plans.ranked import defensive_ledger

    step = "guarded boolean, guard_key string, expression string, verdict string, origin string"
    guards = [(True, "1:1", "d1", "possible", "o"), (True, "2:1", "d1", "possible", "o"), (True, "1:1", "d9", "possible", "o"), (False, "3:1", "d1", "possible", "o")]
    facts = spark.createDataFrame([("f", guards), ("f", guards[:1]), ("f", [])], f"file string, steps array<struct<{step.replace(' ', ':').replace(',:', ',')}>>")
    assert [tuple(r) for r in defensive_ledger(facts).collect()] == [("f", "d1", "possible", "o", 3, 2)]


def test_owned_parts_of_files_need_no_second_join(spark, small):
    from sinkwell.operators import metrics as M

    r = M.Report(spark, small)
    joined = M.actionable(r.roots).join(r.sinks.select("sink_id", "file"), "sink_id").groupBy("file").count()
    got = r.owned().groupBy("file").count()
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in joined.collect()}
