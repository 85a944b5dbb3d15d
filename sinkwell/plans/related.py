"""Queries over joins, diffs, graphs, validation and text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graphs as G
from ..operators import metrics as M
from ..sources import star
from ..sources.stored import stored
from ..sources.tables import table
from .registry import query
from .star_sql import ALL, BASE

#: Sinks that a list of reached or affected sinks shows.  A fixed value.
REACHED = 50

# ---------------------------------------------------------------- joins over facts


@query(
    "join1_reached_via",
    BASE
    + """, fed AS (SELECT label, count(*) AS n FROM owned GROUP BY label), nth AS (SELECT label, sink_id, row_number() OVER (PARTITION BY label ORDER BY sink_id) AS k FROM owned),
    firsts AS (SELECT o.sink_id, o.label, n.sink_id AS other, row_number() OVER (PARTITION BY o.sink_id, o.label ORDER BY n.sink_id) AS j FROM owned o JOIN nth n ON n.label = o.label AND n.k <= 51 AND n.sink_id <> o.sink_id)
    SELECT f.sink_id, f.label, any_value(fed.n) - 1 AS total, string_agg(other, ',' ORDER BY other) AS sinks FROM firsts f JOIN fed USING (label) WHERE j <= 50 GROUP BY f.sink_id, f.label""",
)
def join1(spark, sf):
    return reached_via(M.actionable(M.Report(spark, sf).roots), REACHED)


def reached_via(owned: DataFrame, cap: int) -> DataFrame:
    """JOIN-1: the other sinks of each root, the first ``cap`` and the true number.

    The first ones of a label come from a row number with a constant limit, which is applied on both sides of the shuffle, and its number from an
    aggregate with a partial step; these few are stored, so that both sides of the join back are plain exchanges and a hot label can be split.
    """
    k = F.row_number().over(W.partitionBy("label").orderBy("sink_id"))
    nth = owned.select("label", "sink_id", k.alias("k")).filter(F.col("k") <= cap + 1)
    total = owned.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("n")).filter("n > 1")
    firsts = nth.groupBy("label").agg(F.array_sort(F.collect_list("sink_id")).alias("ids")).join(total, F.col("label") == F.col("_label")).select("label", "ids", "n")
    rows = owned.select("sink_id", "label").join(stored(firsts, "firsts"), "label")
    others = F.slice(F.filter("ids", lambda i: i != F.col("sink_id")), 1, cap)
    return rows.select("sink_id", "label", (F.col("n") - 1).alias("total"), F.array_join(others.cast("array<string>"), ",").alias("sinks"))


def unknown_items(r: M.Report) -> DataFrame:
    rows = r.items.filter("kind = 'unknown'").join(r.sinks.select("sink_id", "seq", "file", "component"), "sink_id")
    return rows.withColumn("label", F.concat(F.lit("part."), "part"))


@query(
    "join2_edges_with_endpoints",
    BASE
    + """ SELECT s.file, 'part.' || i.part AS source_label, p.p_brand AS source_brand, s.label AS target_label, count(*) AS edges FROM items i LEFT JOIN sinks s USING (sink_id) LEFT JOIN part p ON p.p_partkey = i.part
    WHERE i.kind = 'unknown' GROUP BY ALL""",
)
def join2(spark, sf):
    r = M.Report(spark, sf)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("source_brand"))
    rows = r.items.filter("kind = 'unknown'").join(r.sinks.select("sink_id", "file", F.col("label").alias("target_label")), "sink_id", "left").join(part, "part", "left")
    return rows.groupBy("file", F.concat(F.lit("part."), "part").alias("source_label"), "source_brand", "target_label").agg(F.count("*").alias("edges"))


@query(
    "join3_unknown_affected_sinks",
    BASE
    + """, u AS (SELECT DISTINCT s.file, 'part.' || i.part AS label, 'unknown' AS kind FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'unknown'
                 UNION SELECT s.file, 'supplier.' || i.supplier, 'parameter' FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'unknown'),
    by_root AS (SELECT label, kind, sink_id FROM (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY sink_id) AS k FROM roots) WHERE k <= 50),
    hit AS (SELECT u.file, u.label, u.kind, r.sink_id FROM u JOIN by_root r ON r.label = u.label AND r.kind = u.kind
            UNION SELECT u.file, u.label, u.kind, s.sink_id FROM u JOIN items i ON 'part.' || i.part = u.label AND i.kind = u.kind JOIN sinks s ON s.sink_id = i.sink_id AND s.file = u.file),
    nth AS (SELECT *, row_number() OVER (PARTITION BY file, label, kind ORDER BY sink_id) AS k FROM hit)
    SELECT file, label, kind, string_agg(sink_id::VARCHAR, ',' ORDER BY sink_id) AS sinks FROM nth WHERE k <= 50 GROUP BY file, label, kind""",
)
def join3(spark, sf):
    r = M.Report(spark, sf)
    at = r.sinks.select("sink_id", "file")
    unknown = r.items.filter("kind = 'unknown'").join(at, "sink_id")
    part = F.concat(F.lit("part."), "part").alias("label")
    edges = unknown.select("file", part, "kind").union(unknown.select("file", F.concat(F.lit("supplier."), "supplier"), F.lit("parameter"))).distinct()
    return affected_sinks(edges, r.roots, r.items.join(at, "sink_id").select("sink_id", "file", part, "kind"), REACHED)


def affected_sinks(edges: DataFrame, roots: DataFrame, steps: DataFrame, cap: int) -> DataFrame:
    """JOIN-3: the first ``cap`` sinks that an edge (file, label, kind) affects: through a root of its label and kind anywhere, or such a step of its file.

    Rows of kinds that no edge has are left out where they are read, and both sides are cut to their first sinks before they meet the edges.  Repeated
    rows share a rank, so no distinct rows are gathered before the cut.
    """
    edges = stored(edges, "edges")
    kinds = stored(edges.select("kind").distinct(), "kinds")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("_k", F.dense_rank().over(W.partitionBy(*keys).orderBy("sink_id"))).filter(F.col("_k") <= cap).drop("_k")

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        wanted = rows.select("sink_id", *keys).join(kinds, "kind", "left_semi")
        return edges.join(first(wanted, *keys).distinct(), [*keys]).select("file", "label", "kind", "sink_id")

    hits = first(met(roots, "label", "kind").union(met(steps, "file", "label", "kind")), "file", "label", "kind")
    return hits.groupBy("file", "label", "kind").agg(F.array_join(F.array_sort(F.collect_set("sink_id")).cast("array<string>"), ",").alias("sinks"))


@query(
    "join6_fork_sinks",
    BASE
    + """, f AS (SELECT s.file, s.component, i.expression AS subject, count(*) AS sites FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'conditional' GROUP BY ALL HAVING count(*) >= 2),
    k AS (SELECT file, component, count(*) AS gated FROM sinks GROUP BY ALL) SELECT f.*, gated FROM f JOIN k USING (file, component)""",
)
def join6(spark, sf):
    r = M.Report(spark, sf)
    forks = r.items.filter("kind = 'conditional'").join(r.sinks.select("sink_id", "file", "component"), "sink_id").groupBy("file", "component", F.col("expression").alias("subject"))
    forks = forks.agg(F.count("*").alias("sites")).filter("sites >= 2")
    return forks.join(r.sinks.groupBy("file", "component").agg(F.count("*").alias("gated")), ["file", "component"])


@query(
    "join7_sinks_in_branch_ranges",
    BASE
    + """, ranges AS (SELECT c_custkey AS fork, 'src/' || r_name || '/' || n_name || '.tsx' AS file, c_custkey * 10 AS low, c_custkey * 10 + 60 AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT fork, count(*) AS sinks, min(line) AS first_line, max(line) AS last_line FROM ranges r JOIN sinks s ON s.file = r.file AND s.line BETWEEN r.low AND r.high GROUP BY fork""",
)
def join7(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ranges = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ranges = ranges.select(F.col("c_custkey").alias("fork"), F.concat(F.lit("src/"), "r_name", F.lit("/"), "n_name", F.lit(".tsx")).alias("file"), (F.col("c_custkey") * 10).alias("low"), (F.col("c_custkey") * 10 + 60).alias("high"))
    hits = G.range_join(star.sinks(spark, sf).select("file", "line"), ranges, "file", "line", "low", "high", 64)
    return hits.groupBy("fork").agg(F.count("*").alias("sinks"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


CUT = "1998-06-01"
DIFF = f"""{ALL}, keyed AS (SELECT *, file || '::' || signature AS key, made < TIMESTAMP '{CUT}' AS old FROM ranked),
    last AS (SELECT *, row_number() OVER (PARTITION BY key, old ORDER BY round(burden, 9), seq DESC) AS k FROM keyed),
    b AS (SELECT key, burden AS before FROM last WHERE old AND k = 1), c AS (SELECT key, burden AS after FROM last WHERE NOT old AND k = 1)"""


def keyed_diff(rows: DataFrame, old) -> DataFrame:
    """JOIN-8: full outer by file and signature; of several sinks with one key the last in burden order counts."""
    rows = rows.withColumns({"key": F.concat_ws("::", "file", "signature"), "old": old})
    last = rows.groupBy("key", "old").agg(F.max_by("burden", F.struct(-F.round("burden", 9), F.col("seq"))).alias("burden"))
    before = last.filter("old").select("key", F.col("burden").alias("before"))
    after = last.filter("not old").select("key", F.col("burden").alias("after"))
    status = (
        F.when(F.col("after").isNull(), "removed")
        .when(F.col("before").isNull(), "new")
        .when(F.col("after") < F.col("before") - 0.001, "improved")
        .when(F.col("after") > F.col("before") + 0.001, "regressed")
        .otherwise("same")
    )
    return before.join(after, "key", "full_outer").withColumn("status", status)


@query(
    "set4_keyed_diff",
    DIFF + " SELECT key, round(before, 2) AS before, round(after, 2) AS after, CASE WHEN after IS NULL THEN 'removed' WHEN before IS NULL THEN 'new' WHEN after < before - 0.001 THEN 'improved' WHEN after > before + 0.001 THEN 'regressed' ELSE 'same' END AS status FROM b FULL OUTER JOIN c USING (key)",
)
def set4(spark, sf):
    rows = keyed_diff(M.Report(spark, sf).ranked(), F.col("made") < F.lit(CUT).cast("timestamp_ntz"))
    return rows.select("key", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "status")


@query(
    "agg17_metric_deltas",
    DIFF
    + """, s AS (SELECT CASE WHEN old THEN -1 ELSE 1 END AS w, * FROM keyed) SELECT sum(w * actionable)::BIGINT AS fallbacks, sum(w * hops)::BIGINT AS hops, sum(w * churn)::BIGINT AS transformations, sum(w * suspicious)::BIGINT AS packing,
    sum(w * control)::BIGINT AS conditionals FROM s""",
)
def agg17(spark, sf):
    w = F.when(F.col("made") < F.lit(CUT).cast("timestamp_ntz"), -1).otherwise(1)
    names = {"fallbacks": "actionable_defensive_operation_count", "hops": "helper_hops", "transformations": "representation_churn", "packing": "suspicious_pack_count", "conditionals": "control_dependency_count"}
    return M.Report(spark, sf).ranked().agg(*[F.sum(w * F.col(c)).alias(k) for k, c in names.items()])


@query(
    "set5_comparison_state",
    DIFF
    + """, old AS (SELECT file, max(burden) AS b FROM keyed WHERE old GROUP BY file), new AS (SELECT file, max(burden) AS b FROM keyed WHERE NOT old GROUP BY file)
    SELECT new.file, CASE WHEN old.b IS NULL THEN 'new' WHEN new.b > old.b + 0.001 THEN 'worsened' ELSE 'unchanged' END AS state FROM new LEFT JOIN old USING (file)""",
)
def set5(spark, sf):
    rows = M.Report(spark, sf).ranked().withColumn("old", F.col("made") < F.lit(CUT).cast("timestamp_ntz"))
    old = rows.filter("old").groupBy("file").agg(F.max("burden").alias("b"))
    new = rows.filter("not old").groupBy("file").agg(F.max("burden").alias("a"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a") > F.col("b") + 0.001, "worsened").otherwise("unchanged")
    return new.join(old, "file", "left").select("file", state.alias("state"))


@query("set3_families_gone", DIFF + " SELECT DISTINCT signature FROM keyed WHERE old EXCEPT SELECT DISTINCT signature FROM keyed WHERE NOT old")
def set3(spark, sf):
    rows = M.Report(spark, sf).ranked().withColumn("old", F.col("made") < F.lit(CUT).cast("timestamp_ntz"))
    return rows.filter("old").select("signature").distinct().exceptAll(rows.filter("not old").select("signature").distinct())


@query(
    "set6_distinct_defenses",
    BASE + " SELECT s.file, count(*) AS defenses FROM (SELECT DISTINCT s.file, s.line, d.expression, d.verdict FROM defenses d JOIN sinks s USING (sink_id)) s GROUP BY s.file",
)
def set6(spark, sf):
    r = M.Report(spark, sf)
    rows = r.defenses.join(r.sinks.select("sink_id", "file", "line"), "sink_id").select("file", "line", "expression", "verdict").distinct()
    return rows.groupBy("file").agg(F.count("*").alias("defenses"))


@query(
    "agg25_compare_summary",
    ALL
    + """ SELECT round(max(burden), 9) AS worst, count(*) AS findings, count(DISTINCT signature) AS families, sum(impossible)::BIGINT AS impossible, CASE WHEN max(burden) < 0.3 AND sum(impossible) = 0 AND sum(unknown) = 0 AND count(*) < 10 THEN 'stop' ELSE 'go on' END AS recommendation
    FROM ranked WHERE tier = 'finding'""",
)
def agg25(spark, sf):
    rows = M.Report(spark, sf).ranked().filter("tier = 'finding'")
    a = rows.agg(F.max("burden").alias("w"), F.count("*").alias("findings"), F.count_distinct("signature").alias("families"), F.sum("impossible_defense_count").alias("impossible"), F.sum("unknown_edge_count").alias("u"))
    stop = (F.col("w") < 0.3) & (F.col("impossible") == 0) & (F.col("u") == 0) & (F.col("findings") < 10)
    return a.select(F.round("w", 9).alias("worst"), "findings", "families", "impossible", F.when(stop, "stop").otherwise("go on").alias("recommendation"))


@query(
    "agg12_unknown_edges",
    BASE + " SELECT s.file, 'part.' || i.part AS label, count(*) AS occurrences, min(s.seq) AS first_sink FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'unknown' GROUP BY ALL",
)
def agg12(spark, sf):
    return unknown_items(M.Report(spark, sf)).groupBy("file", "label").agg(F.count("*").alias("occurrences"), F.min("seq").alias("first_sink"))


@query("agg13_distinct_unknown", BASE + " SELECT count(*) AS n FROM (SELECT 'part.' || part AS x FROM items WHERE kind = 'unknown' UNION SELECT 'supplier.' || supplier FROM items WHERE kind = 'unknown')")
def agg13(spark, sf):
    rows = M.Report(spark, sf).items.filter("kind = 'unknown'")
    return rows.select(F.concat(F.lit("part."), "part")).union(rows.select(F.concat(F.lit("supplier."), "supplier"))).distinct().agg(F.count("*").alias("n"))


@query(
    "agg8_entry_types",
    BASE
    + """, g AS (SELECT s.file, count(*) AS boundaries FROM defenses d JOIN sinks s USING (sink_id) GROUP BY 1), u AS (SELECT s.file, count(*) AS unknown FROM items i JOIN sinks s USING (sink_id) WHERE kind = 'unknown' GROUP BY 1),
    f AS (SELECT s.file, count(DISTINCT o.label) AS fan_out FROM owned o JOIN sinks s USING (sink_id) GROUP BY 1)
    SELECT file, coalesce(boundaries, 0) AS boundaries, coalesce(unknown, 0) AS unknown, coalesce(fan_out, 0) AS fan_out FROM g FULL JOIN u USING (file) FULL JOIN f USING (file)""",
)
def agg8(spark, sf):
    r = M.Report(spark, sf)
    at = r.sinks.select("sink_id", "file")
    g = r.defenses.join(at, "sink_id").groupBy("file").agg(F.count("*").alias("boundaries"))
    u = r.items.filter("kind = 'unknown'").join(at, "sink_id").groupBy("file").agg(F.count("*").alias("unknown"))
    f = M.actionable(r.roots).join(at, "sink_id").groupBy("file").agg(F.count_distinct("label").alias("fan_out"))
    return g.join(u, "file", "full_outer").join(f, "file", "full_outer").na.fill(0)


@query(
    "agg18_boundary_helpers",
    BASE
    + """, h AS (SELECT supplier, count(DISTINCT part) AS in_sources, count(DISTINCT sink_id) AS callers, count(*) FILTER (WHERE kind = 'object-pack') AS churn, count(*) FILTER (WHERE guarded) AS guards,
      count(*) FILTER (WHERE guarded AND verdict = 'impossible') AS impossible, max(pos) AS depth FROM items GROUP BY supplier), t AS (SELECT *, supplier % 7 = 0 AS leak FROM h)
    SELECT supplier, in_sources, callers, in_sources + churn + guards * 2 + impossible * 3 + depth * 0.5::DOUBLE + CASE WHEN leak THEN 4 ELSE 0 END + CASE WHEN in_sources >= 3 AND callers >= 2 THEN callers * 2 ELSE 0 END AS debt,
    CASE WHEN in_sources >= 3 AND callers >= 2 THEN 'confluence / junction' WHEN leak THEN 'leaky boundary' WHEN depth >= 6 OR churn >= 4 OR guards >= 3 OR impossible > 0 THEN 'messy internals' ELSE 'clean pipe' END AS verdict FROM t""",
)
def agg18(spark, sf):
    from ..functions import classify, scores

    pos = F.row_number().over(W.partitionBy("sink_id").orderBy("item"))
    h = star.items(spark, sf).withColumn("pos", pos).groupBy("supplier").agg(
        F.count_distinct("part").alias("in_sources"),
        F.count_distinct("sink_id").alias("callers"),
        F.count_if(F.col("kind") == "object-pack").alias("churn"),
        F.count_if("guarded").alias("guards"),
        F.count_if(F.col("guarded") & (F.col("verdict") == "impossible")).alias("impossible"),
        F.max("pos").alias("depth"),
    )
    leak, no = F.col("supplier") % 7 == 0, F.lit(False)
    c = F.col
    debt = scores.boundary_debt(c("in_sources"), c("churn"), c("guards"), c("impossible"), c("depth"), leak, c("callers"), no)
    verdict = classify.boundary_verdict(no, c("depth"), no, c("in_sources"), c("callers"), leak, c("churn"), c("guards"), c("impossible"))
    return h.select("supplier", "in_sources", "callers", debt.alias("debt"), verdict.alias("verdict"))


@query(
    "agg20_grouped_recommendations",
    BASE + " SELECT s.file, s.component, i.expression AS thing, count(DISTINCT sink_id) AS sinks, count(DISTINCT part) AS fields FROM items i JOIN sinks s USING (sink_id) GROUP BY ALL HAVING count(DISTINCT sink_id) >= 2 AND count(DISTINCT part) >= 2",
)
def agg20(spark, sf):
    r = M.Report(spark, sf)
    rows = r.items.join(r.sinks.select("sink_id", "file", "component"), "sink_id").groupBy("file", "component", F.col("expression").alias("thing"))
    return rows.agg(F.count_distinct("sink_id").alias("sinks"), F.count_distinct("part").alias("fields")).filter("sinks >= 2 and fields >= 2")


@query(
    "agg33_source_inventory",
    BASE + " SELECT 'part.' || part AS source, count(DISTINCT s.file) AS routes, count(DISTINCT s.component) AS consumers, bool_or(guarded) AS guarded, max(s.seq) FILTER (WHERE i.price = top) AS shape_sink FROM (SELECT *, max(price) OVER (PARTITION BY part) AS top FROM items) i JOIN sinks s USING (sink_id) GROUP BY part",
)
def agg33(spark, sf):
    r = M.Report(spark, sf)
    rows = r.items.join(r.sinks.select("sink_id", "seq", "file", "component"), "sink_id").groupBy(F.concat(F.lit("part."), "part").alias("source"))
    return rows.agg(
        F.count_distinct("file").alias("routes"), F.count_distinct("component").alias("consumers"), F.bool_or("guarded").alias("guarded"), F.max_by("seq", F.struct("price", "seq")).alias("shape_sink")
    )


@query(
    "join14_unique_bridges",
    """WITH e AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS slot FROM events),
    c AS (SELECT *, count(*) OVER (PARTITION BY user_id, slot) AS n FROM e WHERE event_type = 'click'), h AS (SELECT *, count(*) OVER (PARTITION BY user_id, slot) AS n FROM e WHERE event_type = 'view')
    SELECT c.event_id AS client, h.event_id AS handler, c.user_id FROM c JOIN h ON c.user_id = h.user_id AND c.slot = h.slot WHERE c.n = 1 AND h.n = 1""",
)
def join14(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("slot"))
    client = e.filter("event_type = 'click'").select(F.col("event_id").alias("client"), "user_id", "slot")
    handler = e.filter("event_type = 'view'").select(F.col("event_id").alias("handler"), "user_id", "slot")
    return G.unique_pairs(client, handler, ["user_id", "slot"]).select("client", "handler", "user_id")


@query(
    "join19_route_membership",
    BASE + " SELECT p.p_size AS route, s.file, count(DISTINCT s.sink_id) AS members FROM sinks s JOIN items i USING (sink_id) JOIN part p ON p.p_partkey = i.part GROUP BY 1, 2",
)
def join19(spark, sf):
    """A route is a part size; a sink belongs to it once, however many of its steps do."""
    r = M.Report(spark, sf)
    route = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("route"))
    member = r.items.select("sink_id", "part").join(route, "part").select("sink_id", "route").distinct()
    return member.join(r.sinks.select("sink_id", "file"), "sink_id").groupBy("route", "file").agg(F.count("*").alias("members"))


@query(
    "join20_file_inventory",
    BASE
    + """, x AS (SELECT file, 'sink' AS entry, line, label FROM sinks UNION ALL SELECT s.file, 'defense', s.line, d.expression FROM defenses d JOIN sinks s USING (sink_id)
      UNION ALL SELECT s.file, 'unknown', s.line, 'part.' || i.part FROM items i JOIN sinks s USING (sink_id) WHERE kind = 'unknown' UNION ALL SELECT s.file, 'root', s.line, o.label FROM owned o JOIN sinks s USING (sink_id))
    SELECT entry, line, label FROM x WHERE file = 'src/ASIA/NATION_2.tsx'""",
)
def join20(spark, sf):
    return file_inventory(M.Report(spark, sf), "src/ASIA/NATION_2.tsx")


def file_inventory(r: M.Report, file: str) -> DataFrame:
    """JOIN-20/SET-2: one inventory of four kinds of entries for a file; the filter comes first."""
    at = r.sinks.filter(F.col("file") == file).select("sink_id", "line", "label")
    bare = at.drop("label")
    feeds = [
        at.select(F.lit("sink").alias("entry"), "line", "label"),
        r.defenses.join(bare, "sink_id").select(F.lit("defense").alias("entry"), "line", F.col("expression").alias("label")),
        r.items.filter("kind = 'unknown'").join(bare, "sink_id").select(F.lit("unknown").alias("entry"), "line", F.concat(F.lit("part."), "part").alias("label")),
        M.actionable(r.roots).join(bare, "sink_id").select(F.lit("root").alias("entry"), "line", "label"),
    ]
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@query(
    "join22_area_flows",
    """SELECT a.n_name AS from_area, b.n_name AS to_area, count(*) AS flows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY ALL""",
)
def join22(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    src = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("from_area"))
    dst = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("to_area"))
    dst = table(spark, sf, "orders").join(dst, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "to_area")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(src, F.col("l_suppkey") == F.col("s_suppkey")).join(dst, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.filter("from_area <> to_area").groupBy("from_area", "to_area").agg(F.count("*").alias("flows"))


# ---------------------------------------------------------------- graph of the star

GRAPH = """WITH RECURSIVE edges AS (
    SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation UNION SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
    UNION SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier UNION SELECT 's:' || l_suppkey, 'o:' || l_orderkey FROM lineitem UNION SELECT 'p:' || l_partkey, 'o:' || l_orderkey FROM lineitem)"""


def star_edges(spark: SparkSession, sf: str) -> DataFrame:
    return star_rows(spark, sf).distinct()


def star_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the star, repeated ones included: for operators that drop these themselves."""

    def e(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(f"{a}:"), x).alias("src"), F.concat(F.lit(f"{b}:"), y).alias("dst"))

    out = e("nation", "r", "n_regionkey", "n", "n_nationkey")
    for more in (
        e("customer", "n", "c_nationkey", "c", "c_custkey"),
        e("orders", "c", "o_custkey", "o", "o_orderkey"),
        e("supplier", "n", "s_nationkey", "s", "s_suppkey"),
        e("lineitem", "s", "l_suppkey", "o", "l_orderkey"),
        e("lineitem", "p", "l_partkey", "o", "l_orderkey"),
    ):
        out = out.union(more)
    return out


@query(
    "grf1_levels_from_region",
    GRAPH + ", walk(id, d) AS (SELECT 'r:1', 0 UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = id WHERE d < 6) SELECT id, min(d)::INTEGER AS distance FROM walk GROUP BY id",
)
def grf1(spark, sf):
    return G.levels(star_rows(spark, sf), spark.range(1).select(F.lit("r:1").alias("id")))


@query("agg27_degrees", GRAPH + ", o AS (SELECT src AS id, count(DISTINCT dst) AS n_out FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS n_in FROM edges GROUP BY 1) SELECT id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (id)")
def agg27(spark, sf):
    return G.degrees(star_edges(spark, sf))


def order_paths(spark, sf):
    """All simple paths to every order."""
    ends = table(spark, sf, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"))
    return G.simple_paths(star_rows(spark, sf), ends)


PATHS = (
    GRAPH
    + """, walk(path, head, d) AS (SELECT [id], id, 0 FROM (SELECT 'o:' || o_orderkey AS id FROM orders) UNION ALL SELECT list_prepend(src, path), src, d + 1 FROM walk JOIN edges ON dst = head WHERE d < 6 AND NOT list_contains(path, src)),
    done AS (SELECT path FROM walk WHERE NOT EXISTS (SELECT 1 FROM edges WHERE dst = head))"""
)


@query("grf6_simple_paths", PATHS + " SELECT array_to_string(path, '>') AS path, len(path)::INTEGER AS length FROM done")
def grf6(spark, sf):
    return order_paths(spark, sf).select(F.array_join("path", ">").alias("path"), F.size("path").alias("length"))


@query("agg29_merged_steps", PATHS + ", s AS (SELECT path, unnest(range(1, len(path))) AS i FROM done) SELECT path[i] AS src, path[i + 1] AS dst, count(*) AS paths, min(len(path) - i)::INTEGER AS min_depth FROM s GROUP BY 1, 2")
def agg29(spark, sf):
    return G.merged_steps(order_paths(spark, sf))


@query(
    "grf18_contract_hidden",
    GRAPH + ", e2 AS (SELECT * FROM edges WHERE dst NOT LIKE 'p:%' AND src NOT LIKE 'p:%' AND src NOT LIKE 's:%' AND dst NOT LIKE 's:%'), walk(src, dst) AS (SELECT src, dst FROM e2 WHERE src LIKE 'r:%' UNION SELECT w.src, e.dst FROM walk w JOIN e2 e ON e.src = w.dst WHERE w.dst NOT LIKE 'o:%') SELECT DISTINCT src, dst FROM walk WHERE dst LIKE 'o:%'",
)
def grf18(spark, sf):
    e = star_edges(spark, sf).filter("src not like 'p:%' and src not like 's:%' and dst not like 's:%'")
    hidden = e.select(F.explode(F.array("src", "dst")).alias("id")).filter("id like 'n:%' or id like 'c:%'")
    return G.contract(e, hidden)


@query(
    "join12_stitched_paths",
    """WITH made AS (SELECT DISTINCT l_partkey AS part, s_nationkey AS component, l_suppkey AS supplier FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    sole AS (SELECT part FROM made GROUP BY part HAVING count(DISTINCT component) = 1), used AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier, l_orderkey AS o FROM lineitem)
    SELECT 'c:' || o_custkey AS label, concat_ws('>', 'r:' || n_regionkey, 'n:' || n_nationkey, 'c:' || c_custkey, 'o:' || o_orderkey) AS path, 2 AS hops
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 's:' || supplier, concat_ws('>', 'r:' || n_regionkey, 'n:' || n_nationkey, 's:' || supplier, 'o:' || o), 2
    FROM (SELECT DISTINCT supplier, o FROM used) JOIN supplier ON s_suppkey = supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'p:' || m.part, concat_ws('>', 'r:' || n_regionkey, 'n:' || n_nationkey, 's:' || m.supplier, 'p:' || m.part, 'o:' || u.o), 3
    FROM made m JOIN sole USING (part) JOIN (SELECT DISTINCT part, o FROM used) u ON u.part = m.part JOIN supplier ON s_suppkey = m.supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def join12(spark, sf):
    """Regions hand to nations, nations to customers and suppliers, suppliers to parts (only where all are of one nation), these to orders."""

    def name(kind: str, column: str):
        return F.concat(F.lit(f"{kind}:"), column)

    def segment(rows: DataFrame, feeds, fed_by, component, path):
        text = F.lit(None).cast("string")
        return rows.select((text if feeds is None else feeds).alias("feeds"), (text if fed_by is None else fed_by).alias("fed_by"), component.cast("string").alias("component"), F.array(path).alias("path")).distinct()

    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    li, none = table(spark, sf, "lineitem"), F.lit(None)
    by_nation = li.select("l_partkey", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    n, c, s, p, o = name("n", "n_nationkey"), name("c", "c_custkey"), name("s", "s_suppkey"), name("p", "l_partkey"), name("o", "l_orderkey")
    rows = [
        segment(nation, n, None, F.col("n_regionkey"), name("r", "n_regionkey")),
        segment(customer, c, name("n", "c_nationkey"), F.col("c_nationkey"), name("n", "c_nationkey")),
        segment(supplier, s, name("n", "s_nationkey"), F.col("s_nationkey"), name("n", "s_nationkey")),
        segment(by_nation, p, s, F.col("s_nationkey"), s),
        segment(table(spark, sf, "orders"), None, name("c", "o_custkey"), none, F.concat_ws(">", name("c", "o_custkey"), name("o", "o_orderkey"))),
        segment(li, None, name("s", "l_suppkey"), none, F.concat_ws(">", name("s", "l_suppkey"), o)),
        segment(li, None, p, none, F.concat_ws(">", p, o)),
    ]
    return G.stitched(reduce(DataFrame.union, rows)).select("label", F.array_join("path", ">").alias("path"), "hops")


@query("join21_dangling_edges", GRAPH + " SELECT dst AS id, 'dst' AS end, count(*) AS n FROM edges WHERE dst LIKE 'o:%' AND dst NOT IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY dst")
def join21(spark, sf):
    e = star_edges(spark, sf).filter("dst like 'o:%'")
    nodes = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"))
    return G.dangling(e, nodes.union(e.select("src"))).filter("end = 'dst'")


@query("val1_repeated_ids", "SELECT l_orderkey || ':' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def val1(spark, sf):
    return G.repeated_ids(table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")))


@query(
    "val3_counts_agree",
    BASE + " SELECT s.file, count(*) AS emitted, count(*) FILTER (WHERE c.n IS NULL) AS omitted, (count(*) FILTER (WHERE c.n IS NULL)) > 0 AS truncated FROM sinks s LEFT JOIN (SELECT sink_id, count(*) AS n FROM items GROUP BY 1) c USING (sink_id) GROUP BY s.file",
)
def val3(spark, sf):
    r = M.Report(spark, sf)
    rows = r.sinks.join(r.items.groupBy("sink_id").agg(F.count("*").alias("n")), "sink_id", "left").groupBy("file")
    omitted = F.count_if(F.col("n").isNull())
    return rows.agg(F.count("*").alias("emitted"), omitted.alias("omitted"), (omitted > 0).alias("truncated"))


@query(
    "win13_representative_edges",
    """WITH e AS (SELECT n_name AS area, l_suppkey AS src, l_orderkey AS dst, sum(l_extendedprice) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY w DESC, src, dst) AS k FROM e) SELECT area, src, dst, CASE WHEN area = 'NATION_3' THEN 0 WHEN k <= 5 THEN 1 ELSE 2 END AS tier FROM r ORDER BY tier, w DESC, src, dst LIMIT 800""",
)
def win13(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("area"))
    e = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("area", F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst")).agg(F.sum("l_extendedprice").alias("w"))
    k = F.row_number().over(W.partitionBy("area").orderBy(F.desc("w"), "src", "dst"))
    tier = F.when(F.col("area") == "NATION_3", 0).when(F.col("k") <= 5, 1).otherwise(2)
    return e.withColumn("k", k).withColumn("tier", tier).orderBy("tier", F.desc("w"), "src", "dst").limit(800).select("area", "src", "dst", "tier")


@query(
    "win24_map_lanes",
    BASE
    + """, v AS (SELECT s.file, CASE s.category WHEN 'event-handler' THEN 'source' WHEN 'rendered-value' THEN 'terminal' ELSE 'flow' END AS role, count(*) AS volume FROM items i JOIN sinks s USING (sink_id) GROUP BY ALL)
    SELECT role, file, volume, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY volume DESC, file) AS k FROM v) WHERE k <= 12""",
)
def win24(spark, sf):
    r = M.Report(spark, sf)
    role = F.when(F.col("category") == "event-handler", "source").when(F.col("category") == "rendered-value", "terminal").otherwise("flow")
    v = r.items.join(r.sinks.select("sink_id", "file", role.alias("role")), "sink_id").groupBy("role", "file").agg(F.count("*").alias("volume"))
    return v.withColumn("place", F.row_number().over(W.partitionBy("role").orderBy(F.desc("volume"), "file"))).filter("place <= 12")


@query("win12_nested_sites")
def win12(spark, sf):
    from ..operators.ranking import nested_removed

    sites = star.sinks(spark, sf).select("file", F.col("line").alias("start"), (F.col("line") + F.pmod(F.col("line"), F.lit(37)) * 3).alias("end"))
    return nested_removed(sites)


# ---------------------------------------------------------------- functions


@query(
    "fn15_case_words",
    """SELECT p_partkey, lower(p_type) AS words, replace(upper(p_name[1:1]) || p_name[2:], ' ', '') AS joined, CASE WHEN regexp_matches(p_name, '^[aeiou]') THEN 'an' ELSE 'a' END AS article,
    CASE WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' WHEN regexp_matches(p_name, '[^aeiou]y$') THEN regexp_replace(p_name, 'y$', 'ies') ELSE p_name || 's' END AS many FROM part""",
)
def fn15(spark, sf):
    n = F.col("p_name")
    joined = F.concat(F.upper(F.substring(n, 1, 1)), F.replace(F.substring(n, F.lit(2), F.char_length(n)), F.lit(" "), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", T.words(F.col("p_type")).alias("words"), joined.alias("joined"), T.article(n).alias("article"), T.plural(n).alias("many"))


@query(
    "fn12_format_expression",
    r"""WITH t AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM benchmark), c AS (SELECT item_id, s, s[1:39] AS cut, regexp_extract(s[1:39], '^(.*)[^\p{L}\p{N}_$]', 1) AS b FROM t)
    SELECT item_id, CASE WHEN length(s) <= 40 THEN s WHEN length(b) >= 0.6 * 39 THEN b || '…' ELSE cut || '…' END AS text FROM c""",
)
def fn12(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.format_expression(F.col("text"), 40).alias("text"))


@query("fn18_feature_key", BASE + " SELECT sink_id, string_split(file, '/')[2] AS feature_key, 'part' AS family FROM sinks")
def fn18(spark, sf):
    return star.sinks(spark, sf).select("sink_id", T.feature_of(F.col("file")).alias("feature_key"), T.source_family(F.lit("part")).alias("family"))


@query(
    "fn22_stable_hash",
    BASE
    + """, k AS (SELECT sink_id, file || ':' || line || ':' || category AS s FROM sinks), h AS (SELECT sink_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS v FROM k)
    SELECT sink_id, lower(to_base(v, 36)) AS id FROM h""",
)
def fn22(spark, sf):
    key = F.concat_ws(":", "file", F.col("line").cast("string"), "category")
    return star.sinks(spark, sf).select("sink_id", T.fnv1a36(key).alias("id"))


@query("flt2_glob_pages", r"SELECT page_id FROM pages WHERE regexp_matches(url, '^(.*/)?en/([^/]*)$') OR regexp_matches(url, '^(.*/)?fr/.*page=[^/]*$')")
def flt2(spark, sf):
    return table(spark, sf, "pages").filter(T.matches_any(F.col("url"), ["en/*", "fr/**page=*"])).select("page_id")


@query("flt10_overview_filter", ALL + " SELECT sink_id FROM ranked WHERE tier = 'finding' AND (lower(file) LIKE '%europe%' OR lower(label) LIKE '%europe%')")
def flt10(spark, sf):
    rows = M.Report(spark, sf).ranked().filter("tier = 'finding'")
    return rows.filter(F.lower("file").contains("europe") | F.lower("label").contains("europe")).select("sink_id")


@query("snk4_json_payload", ALL + """ SELECT sink_id, '{"id":' || sink_id || ',"file":"' || file || '","depth":' || n || ',"signature":"' || signature || '"}' AS payload FROM ordered WHERE rank <= 12""")
def snk4(spark, sf):
    from ..operators.ranking import head

    body = F.struct(F.col("sink_id").alias("id"), "file", F.col("maximum_path_depth").alias("depth"), "signature")
    return head(M.Report(spark, sf).ranked(), 12).select("sink_id", F.to_json(body).alias("payload"))


@query("snk3_graph_sample", "SELECT min(k) AS first_edge, count(*) FILTER (WHERE k <= 500) AS kept, greatest(count(*) - 500, 0) AS omitted FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS k FROM orders)")
def snk3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    kept = orders.orderBy("o_orderkey").limit(500).agg(F.count("*").alias("kept"))
    total = orders.agg(F.count("*").alias("n")).scalar()
    return kept.select(F.lit(1).cast("long").alias("first_edge"), "kept", F.greatest(total - 500, F.lit(0).cast("long")).alias("omitted"))
