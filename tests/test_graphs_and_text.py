"""Micro-fixtures of graph operators, text functions and classifications."""

import pytest
from pyspark.sql import functions as F

from sinkwell.functions import classify, text
from sinkwell.operators import graphs as G
from sinkwell.operators import metrics as M


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_all_paths_merge_at_a_call(spark):
    edges = edges_of(spark, [("a", "c"), ("b", "c"), ("c", "d")])
    paths = G.simple_paths(edges, spark.createDataFrame([("d",)], "id string"), 5)
    assert sorted(r.path for r in paths.collect()) == [["a", "c", "d"], ["b", "c", "d"]]
    assert not any(r.truncated for r in paths.collect())
    merged = {(r.src, r.dst): (r.paths, r.min_depth) for r in G.merged_steps(paths).collect()}
    assert merged == {("a", "c"): (1, 2), ("b", "c"): (1, 2), ("c", "d"): (2, 1)}


def test_cycles_do_not_repeat_a_vertex(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("s", "a")])
    paths = G.simple_paths(edges, spark.createDataFrame([("c",)], "id string"))
    assert not any(r.truncated for r in paths.collect())
    assert sorted(r.path for r in paths.collect()) == [["s", "a", "b", "c"]]
    found = {r.id: r.distance for r in G.levels(edges, spark.createDataFrame([("s",)], "id string"), 9).collect()}
    assert found == {"s": 0, "a": 1, "b": 2, "c": 3}


def test_long_chains_are_followed_to_their_ends(spark):
    chain = [(f"v{i:03}", f"v{i + 1:03}") for i in range(9)]
    end, start = spark.createDataFrame([("v009",)], "id string"), spark.createDataFrame([("v000",)], "id string")
    edges = edges_of(spark, chain)
    assert {r.id: r.distance for r in G.levels(edges, start).collect()} == {f"v{i:03}": i for i in range(10)}
    assert {r.id for r in G.levels(edges, start, 2).collect()} == {"v000", "v001", "v002"}
    assert [len(r.path) for r in G.simple_paths(edges, end).collect()] == [10]
    cut = G.simple_paths(edges, end, 3).collect()
    assert [(r.path, r.truncated) for r in cut] == [(["v006", "v007", "v008", "v009"], True)]
    hidden = spark.createDataFrame([(f"v{i:03}",) for i in range(1, 9)], "id string")
    assert [tuple(r) for r in G.contract(edges, hidden).collect()] == [("v000", "v009")]
    best = G.best_paths(edges.withColumn("status", F.lit("proven")), start)
    assert max(len(r.path) for r in best.collect()) == 10


def test_longest_paths_are_ordered_by_their_text(spark):
    from sinkwell.plans.views import longest_first

    paths = spark.createDataFrame([(["a:1", "z"],), (["a:10", "z"],), (["b"],)], "path array<string>")
    assert [tuple(r) for r in longest_first(paths, 2).collect()] == [("a:10>z", 2), ("a:1>z", 2)]
    assert [r.path for r in longest_first(paths, 1).collect()] == ["a:10>z"]


SEGMENTS = "feeds string, fed_by string, component string, path array<string>"


def test_stitching_needs_one_producer_component(spark):
    rows = [("x", None, "A", ["p"]), ("y", None, "A", ["q"]), ("y", None, "B", ["r"]), (None, "x", "C", ["u", "v"]), (None, "y", "C", ["w"]), (None, None, "C", ["alone"])]
    assert [tuple(r) for r in G.stitched(spark.createDataFrame(rows, SEGMENTS)).collect()] == [("x", ["p", "u", "v"], 1, False)]


def test_stitching_goes_through_several_components(spark):
    rows = [("x", None, "A", ["a"]), ("y", "x", "B", ["b"]), ("z", "y", "C", ["c"]), (None, "z", "D", ["d"])]
    rows += [("loop", "back", "E", ["e"]), ("back", "loop", "F", ["f"]), (None, "loop", "G", ["g"]), ("open", "nobody", "H", ["h"]), (None, "open", "I", ["i"])]
    got = {r.label: (r.path, r.hops) for r in G.stitched(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert got == {"z": (["a", "b", "c", "d"], 3), "loop": (["f", "e", "g"], 2), "open": (["h", "i"], 1)}
    cut = G.stitched(spark.createDataFrame(rows, SEGMENTS), 1).collect()
    assert {r.label: r.truncated for r in cut} == {"z": True, "loop": True, "open": True}


def test_contraction_and_unique_pairs(spark):
    edges = edges_of(spark, [("a", "h"), ("h", "k"), ("k", "b"), ("a", "c"), ("h", "a"), ("k", "h")])
    hidden = spark.createDataFrame([("h",), ("k",)], "id string")
    assert sorted((r.src, r.dst) for r in G.contract(edges, hidden).collect()) == [("a", "b"), ("a", "c")]
    left = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "l long, k string")
    right = spark.createDataFrame([(7, "x"), (8, "y")], "r long, k string")
    assert [(r.l, r.r) for r in G.unique_pairs(left, right, ["k"]).collect()] == [(3, 8)]


def test_affected_sinks_are_capped_and_need_label_and_kind(spark):
    from sinkwell.plans.related import affected_sinks

    edges = spark.createDataFrame([("f", "x", "unknown"), ("g", "r", "source")], "file string, label string, kind string")
    roots = spark.createDataFrame([(i, "r", "source") for i in range(80)] + [(200, "r", "literal"), (201, "x", "source")], "sink_id long, label string, kind string")
    steps = spark.createDataFrame([(7, "f", "x", "unknown"), (9, "f", "x", "call"), (8, "g", "x", "unknown"), (3, "f", "x", "unknown")], "sink_id long, file string, label string, kind string")
    got = {r.file: r.sinks for r in affected_sinks(edges, roots, steps, 50).collect()}
    assert got == {"f": "3,7", "g": ",".join(map(str, range(50)))}


def test_range_join_over_bins(spark):
    points = spark.createDataFrame([("f", i) for i in range(0, 300, 7)], "key string, at long")
    ranges = spark.createDataFrame([(1, "f", 0, 0), (2, "f", 60, 200), (3, "g", 0, 300)], "id long, key string, low long, high long")
    got = sorted((r.id, r.at) for r in G.range_join(points, ranges, "key", "at", "low", "high", 16).collect())
    assert got == [(i, p) for i, a, b in ((1, 0, 0), (2, 60, 200)) for p in range(0, 300, 7) if a <= p <= b]


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3, 9], 9), ([1, 1, 1], 3), ([5], 5), ([4, 4, 4, 4, 10, 20, 30, 40], 30), ([], 3)])
def test_floor_quantile_is_not_a_percentile(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert M.floor_quantile(df, "v", 0.75, 3).first().threshold == want


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert value(spark, text.words(F.lit("rowCount_of.HTMLItems"))) == "row count of htmlitems"
    assert value(spark, text.pascal(F.lit("rowCount"))) == "RowCount"
    assert value(spark, text.camel(F.lit("RowCount"))) == "rowCount"
    assert value(spark, text.singular(F.lit("entries"))) == "entry"
    assert value(spark, text.plural(F.lit("box"))) == "boxes"
    assert value(spark, text.route_pattern(F.lit("src/routes/(app)/boards/[id]/index.tsx"))) == "/boards/:id"
    assert value(spark, text.route_pattern(F.lit("src/routes/index.tsx"))) == "/"
    assert value(spark, text.feature_of(F.lit("src/a/b/c/d/e.tsx"))) == "a/b/c"
    assert value(spark, text.source_family(F.lit("props.board.title"))) == "props.board"
    assert value(spark, text.shell_quote(F.lit("it's"))) == "'it'\\''s'"
    path = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("property", "a"), ("property", "b"), ("key", "k"), ("index", "0"), ("any", ""))])
    assert value(spark, text.field_path(path)) == 'a.b["k"][0][*]'
    assert value(spark, text.fnv1a36(F.lit("a"))) == "1r9wi6k"[:0] + __import__("numpy").base_repr(((2166136261 ^ 97) * 16777619) % 2**32, 36).lower()
    assert value(spark, text.fnv1a36(F.lit(""))) == __import__("numpy").base_repr(2166136261, 36).lower()
    long = "props.board.description.toUpperCase().trim()"
    assert value(spark, text.format_expression(F.lit(long), 30)) == "props.board.description…"


def test_positive_limits(spark):
    cases = [(7.9, 7), (1.0, 1), (0.9, 12), (-3.0, 12), (None, 12), (float("nan"), 12), (float("inf"), 12)]
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    got = {r.i: r.n for r in rows.select("i", text.positive_limit(F.col("v"), 12.7).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}
    assert rows.select(text.positive_limit(F.lit(None).cast("int"), 0.2).alias("n")).first().n == 1


def test_gaps_with_unknown_ends_fail(spark):
    elements = spark.createDataFrame([("a",), ("b",)], "id string")
    gaps = spark.createDataFrame([("g1", "a", None), ("g2", "a", "b")], "id string, src string, dst string")
    assert sorted(tuple(r) for r in G.checked_gaps(gaps, elements).select("id", "src", "dst").collect()) == [("g1", "a", None), ("g2", "a", "b")]
    bad = spark.createDataFrame([("g3", "a", "zz")], "id string, src string, dst string")
    with pytest.raises(Exception, match="unknown dst zz"):
        G.checked_gaps(bad, elements).collect()


def test_nine_shape_tags(spark):
    metrics = {"control_dependency_count": 0, "defensive_operation_count": 0, "representation_churn": 0, "merge_width": 0, "helper_hops": 0, "pack_risk": 0}

    def tags(attr, category="attribute", prop=False, relay=False, steps="", path=None, template=False, origins=(), **given):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (metrics | given).items()])
        c = classify.shapes(F.lit(attr), F.lit(category), F.lit(prop), F.lit(relay), F.lit(steps), F.lit(path or steps), F.lit(template), F.array(*map(F.lit, origins)).cast("array<string>"))
        return row.select(c.alias("t"), classify.primary_shape(c, classify.family(F.lit(attr), F.lit(category)), F.lit(category)).alias("p")).first()

    assert tags("viewbox").t == ["svg-shell"]
    assert tags("cx", path="cx center radius").t == ["local-scalar-geometry", "geometry-chain"]
    assert tags("cx", path="items.map(center)").t == ["geometry-chain"] and tags("cx", path="center", pack_risk=7).t == ["geometry-chain"]
    assert tags("title", template=True, control_dependency_count=1).t == ["geometry-chain"]
    assert tags("title", steps="rows.filter(x)").t == ["collection-render-model"] and tags("each", "render-control").p == "collection-render-model"
    assert tags("when", "render-control").p == "control-flow-gate"
    assert tags("class", "attribute", representation_churn=1).t == ["presentation-pack"]
    both = tags("title", defensive_operation_count=1, origins=["Solid prop default"])
    assert both.t == ["domain-normalization", "solid-prop-default-boundary"] and both.p == "solid-prop-default-boundary"
    assert tags("title", relay=True, merge_width=2).t == ["cross-component-relay"] and tags("title").p == "uncategorized"


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/*.tsx", "src/a.tsx", True), ("src/*.tsx", "src/b/a.tsx", False), ("src/**/*.tsx", "src/b/c/a.tsx", True), ("components", "src/components/a.tsx", True), ("a?.ts", "x/ab.ts", True), ("a?.ts", "x/abc.ts", False)])
def test_globs(spark, glob, path, hit):
    assert value(spark, text.matches_any(F.lit(path), [glob])) is hit


def test_classifications(spark):
    i, b = F.lit, F.lit
    verdict = classify.boundary_verdict
    no = b(False)
    assert value(spark, verdict(b(True), i(1), no, i(9), i(9), no, i(0), i(0), i(0))) == "thin pass-through (inline)"
    assert value(spark, verdict(no, i(1), no, i(3), i(2), b(True), i(0), i(0), i(0))) == "confluence / junction"
    assert value(spark, verdict(no, i(1), no, i(1), i(2), b(True), i(9), i(0), i(0))) == "leaky boundary"
    assert value(spark, verdict(no, i(6), no, i(1), i(2), no, i(0), i(0), i(0))) == "messy internals"
    assert value(spark, classify.type_leak(F.lit("a | b | c | d | e"))) and not value(spark, classify.type_leak(F.lit("company")))
    assert value(spark, classify.depth_band(i(7))) == "medium"
    assert value(spark, classify.queue(i(0), no, i(3), i(0), 3)) == "central-leverage"
    assert value(spark, classify.pack_risk(F.lit("relay-bag"))) == 12
    assert value(spark, classify.family(F.lit("viewBox"), F.lit("attribute"))) == "svg-shell"


def test_affected_sinks_leave_out_rows_of_kinds_that_no_edge_has(spark):
    from sinkwell.plans.related import affected_sinks

    edges = spark.createDataFrame([("f", "a", "unknown"), ("g", "a", "unknown"), ("f", "b", "parameter"), ("f", "a", "unknown")], "file string, label string, kind string")
    roots = spark.createDataFrame([(i, "b", "parameter") for i in (9, 3, 3, 5, 7)] + [(i, "a", "literal") for i in range(50)], "sink_id long, label string, kind string")
    steps = spark.createDataFrame([(4, "f", "a", "unknown"), (4, "f", "a", "unknown"), (1, "g", "a", "unknown"), (2, "f", "a", "call")], "sink_id long, file string, label string, kind string")
    out = affected_sinks(edges, roots, steps, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 2  # before, all kinds were made distinct and ranked
    assert sorted(map(tuple, out.collect())) == [("f", "a", "unknown", "4"), ("f", "b", "parameter", "3,5,7"), ("g", "a", "unknown", "1")]
