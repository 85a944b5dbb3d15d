"""Bounded choices against plain loops; hot labels; exact quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from sinkwell.operators import choices

AREAS = "id string, path string, findings long, sinks long, sources long"
TRAJECTORIES = "id long, burden double, areas array<string>"


def plain_areas(areas, trajectories, focus, most, most_trajectories):
    order = lambda a: (-a[2], -a[3], -a[4], a[1])
    by_id, chosen = {a[0]: a for a in areas}, []

    def add(i):
        if i in by_id and i not in chosen and len(chosen) < most:
            chosen.append(i)

    if focus is not None:
        add(focus)
    first = sorted(trajectories, key=lambda t: (not (focus is not None and focus in (t[2] or [])), -t[1], t[0]))[:most_trajectories]
    for t in first:
        for i in t[2] or []:
            add(i)
    lists = [sorted((a for a in areas if a[c] > 0), key=order) for c in (4, 3)]
    for n in range(max(map(len, lists))):
        for mine in lists:
            if n < len(mine):
                add(mine[n][0])
    for a in sorted(areas, key=lambda a: (a[1], a[0])):
        add(a[0])
    return [a[0] for a in sorted((by_id[i] for i in chosen), key=order)]


@pytest.mark.parametrize("focus", [None, "a3", "nowhere"])
def test_areas_are_chosen_in_four_tiers(spark, focus):
    rng = random.Random(3)
    areas = [(f"a{i}", f"p{i:02}", rng.randrange(3), rng.choice([0, 0, 1, 5]), rng.choice([0, 0, 2, 7])) for i in range(40)]
    trajectories = [(i, rng.choice([0.1, 0.5, 0.9]), rng.choice([None, [f"a{rng.randrange(45)}" for _ in range(rng.randrange(4))]])) for i in range(30)]
    frames = spark.createDataFrame(areas, AREAS), spark.createDataFrame(trajectories, TRAJECTORIES)
    for most, paths in ((5, 2), (20, 3), (39, 30), (400, 400)):
        got = choices.select_areas(*frames, focus=focus, most=most, most_trajectories=paths).collect()
        assert [r.id for r in got] == plain_areas(areas, trajectories, focus, most, paths)
    assert choices.select_areas(frames[0].limit(0), frames[1]).collect() == []


ROUTES = "kind string, pattern string, file string, sources array<struct<key:string,label:string>>, total_steps int, trajectories int, unique_steps int, substitutions int, gaps int"


def test_the_atlas_filters_and_sorts_without_a_cap(spark):
    rows = [("page" if i % 3 else "api", f"/r{i:03}", f"f{i % 4}.tsx", [(f"s{i % 5}", f"Label {i % 5}")] if i % 7 else [], i % 11, i % 6, i % 9, i % 4, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, ROUTES)
    assert choices.route_atlas(df).count() == 120
    for sort, at in (("steps", 4), ("paths", 5), ("unique", 6), ("substitutions", 7), ("gaps", 8)):
        want = [r[1] for r in sorted(rows, key=lambda r: (-r[at], r[1])) if r[0] == "page"]
        assert [r.pattern for r in choices.route_atlas(df, kind="page", sort=sort).collect()] == want
    found = {r.pattern for r in choices.route_atlas(df, text=" LABEL 3 ").collect()}
    assert found == {r[1] for r in rows if r[3] and r[3][0][1] == "Label 3"}
    assert {r.pattern for r in choices.route_atlas(df, source="s2").collect()} == {r[1] for r in rows if r[3] and r[3][0][0] == "s2"}
    assert choices.route_atlas(df, source="unknown").count() == 120
    with pytest.raises(ValueError):
        choices.route_atlas(df, sort="weight")


def test_trajectories_by_five_keys_and_a_sample_of_a_graph(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", rng.randrange(3), rng.randrange(2), rng.random() < 0.5, f"t{rng.randrange(3)}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, length int, substitutions int, complete boolean, terminal string")
    want = sorted(rows, key=lambda r: (-r[1], -r[2], not r[3], r[4], r[0]))[:25]
    assert [r.key for r in choices.complex_first(df, 25).collect()] == [r[0] for r in want]
    nodes, edges = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "seq long, id string"), spark.createDataFrame([(9 - i, f"e{i}") for i in range(9)], "seq long, id string")
    got = sorted(map(tuple, choices.bounded_graph(nodes, edges, 5).collect()))
    assert got == sorted([("node", i, f"n{i}", 0) for i in range(4)] + [("edge", 9 - i, f"e{i}", 4) for i in range(4, 9)])


# ---------------------------------------------------------------- hot labels, quantiles


def test_a_hot_label_is_limited_before_it_is_sorted(spark):
    from sinkwell.plans.related import reached_via

    rows = [(i, "hot" if i % 3 == 0 else f"l{i % 50}") for i in range(900)] + [(i, "hot") for i in range(2000, 2010)]
    owned = spark.createDataFrame(rows, "sink_id long, label string")
    out = reached_via(owned, 5)
    by = {}
    for i, label in rows:
        by.setdefault(label, []).append(i)
    for r in out.collect():
        others = sorted(x for x in by[r.label] if x != r.sink_id)
        assert r.total == len(others) and r.sinks == ",".join(map(str, others[:5]))
    assert out.count() == len([1 for i, label in rows if len(by[label]) > 1])


@pytest.mark.parametrize("share,least", [(0.75, 3), (0.0, 0), (0.999, 1), (1.0, 0)])
def test_the_quantile_is_exact_over_any_range(spark, share, least):
    from sinkwell.operators.metrics import floor_quantile

    rng = random.Random(5)
    for values in ([1, 1, 1, 9], [rng.randrange(10**12) for _ in range(500)] + [1] * 300, [2**62, 5, 2**40 + 1, 7], [rng.randrange(70_000) for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        want = max(least, sorted(values)[min(len(values) - 1, int(share * len(values)))])
        assert floor_quantile(df, "v", share, least).first().threshold == want
    assert floor_quantile(spark.createDataFrame([], "v long"), "v", share, least).first().threshold == least


def test_the_quantile_has_no_window_over_all_values(spark):
    from sinkwell.operators.metrics import LEVEL_BITS, floor_quantile

    df = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    out = floor_quantile(df, "v", 0.75, 1)
    values = sorted(i * 7919 % 1_000_003 for i in range(200_000))
    assert out.first().threshold == values[150_000] and LEVEL_BITS <= 16
