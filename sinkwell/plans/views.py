"""The report views by name, and the queries that remain: paths under budgets, ranks, validation, hashing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators.ranking import CHOSEN
from ..operators.unique import unique_search
from ..sources import markup, star
from ..sources.tables import table
from .ranked import agg4, agg15, agg21, fan_out
from .registry import query
from .related import GRAPH, PATHS, agg18, order_paths, star_edges, star_rows
from .star_sql import ALL, BASE


def findings(spark, sf, n: int = 12) -> DataFrame:
    rows = R.head(M.Report(spark, sf).ranked(), n)
    return rows.select("sink_id", "file", "label", "tier", "signature", "shape", "ownership", F.round("burden", 6).alias("burden"))


@query("vw2_findings", ALL + " SELECT sink_id, file, label, tier, signature, shape, ownership, round(burden, 6) AS burden FROM ordered WHERE rank <= 12")
def vw2(spark, sf):
    return findings(spark, sf)


@query("vw5_fan_out", BASE + """, keyed AS (SELECT o.*, s.file, s.seq, CASE WHEN kind = 'prop-read' THEN component || '::' || o.label ELSE o.label END AS key FROM owned o JOIN sinks s USING (sink_id))
    SELECT key, count(*) AS total, count(DISTINCT file) AS files, min(seq) AS first_sink FROM keyed GROUP BY key ORDER BY total DESC, key LIMIT 12""")
def vw5(spark, sf):
    return fan_out(M.Report(spark, sf)).orderBy(F.desc("total"), "key").limit(12).select("key", "total", "files", "first_sink")


@query("vw6_fan_in", ALL + " SELECT sink_id, merge_width, control AS predicates, n AS max_distance FROM ordered WHERE merge_width >= 2 ORDER BY rank LIMIT 12")
def vw6(spark, sf):
    rows = R.head(M.Report(spark, sf).ranked().filter("merge_width >= 2"), 12)
    return rows.select("sink_id", "merge_width", F.col("control_dependency_count").alias("predicates"), F.col("maximum_path_depth").alias("max_distance"))


HELPERS = BASE + """, h AS (SELECT supplier, count(DISTINCT part) AS in_sources, count(DISTINCT sink_id) AS callers, count(*) FILTER (WHERE kind = 'object-pack') AS churn FROM items GROUP BY supplier)"""


@query("vw12_junctions", HELPERS + " SELECT supplier, in_sources, callers, in_sources * greatest(1, callers) AS weight FROM h WHERE in_sources >= 3 AND callers >= 2 ORDER BY weight DESC, supplier LIMIT 12")
def vw12(spark, sf):
    rows = agg18(spark, sf).filter("in_sources >= 3 and callers >= 2").withColumn("weight", F.col("in_sources") * F.greatest(F.lit(1).cast("long"), F.col("callers")))
    return rows.orderBy(F.desc("weight"), "supplier").limit(12).select("supplier", "in_sources", "callers", "weight")


@query("vw13_inline_preview", HELPERS + """ SELECT supplier, decision, CASE decision WHEN 'inline' THEN 0 WHEN 'inline with care' THEN 1 WHEN 'keep' THEN 2 ELSE 3 END AS verdict_rank
    FROM (SELECT supplier, CASE WHEN callers <= 1 THEN 'inline' WHEN callers <= 3 AND churn = 0 THEN 'inline with care' WHEN in_sources < callers THEN 'keep' ELSE 'keep boundary' END AS decision FROM h)""")
def vw13(spark, sf):
    rows = star.items(spark, sf).groupBy("supplier").agg(F.count_distinct("part").alias("in_sources"), F.count_distinct("sink_id").alias("callers"), F.count_if(F.col("kind") == "object-pack").alias("churn"))
    decision = F.when(F.col("callers") <= 1, "inline").when((F.col("callers") <= 3) & (F.col("churn") == 0), "inline with care").when(F.col("in_sources") < F.col("callers"), "keep").otherwise("keep boundary")
    rank = F.when(F.col("decision") == "inline", 0).when(F.col("decision") == "inline with care", 1).when(F.col("decision") == "keep", 2).otherwise(3)
    return rows.select("supplier", decision.alias("decision")).withColumn("verdict_rank", rank)


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "findings": findings,
    "path-families": agg4,
    "defensive-ledger": agg15,
    "repeated-forks": agg21,
    "boundary-report": agg18,
    "fan-out": vw5,
    "fan-in": vw6,
    "junctions": vw12,
    "inline-preview": vw13,
}


def write_views(spark: SparkSession, sf: str, path: str, names: list[str] | None = None) -> list[str]:
    """SNK-1/SNK-2: each view as JSON lines in a folder of its own."""
    names = names or list(VIEWS)
    for name in names:
        VIEWS[name](spark, sf).write.mode("overwrite").json(f"{path}/view={name}")
    return names


# ---------------------------------------------------------------- paths


def statused(spark, sf):
    partial = F.col("src").startswith("s:") & F.col("dst").startswith("o:")
    return star_edges(spark, sf).filter("src not like 'p:%'").withColumn("status", F.when(partial, "partial").otherwise("proven"))


@query(
    "grf12_best_paths",
    GRAPH
    + """, walk(id, path, d) AS (SELECT 'r:1', ['r:1'], 0 UNION ALL SELECT dst, list_append(path, dst), d + 1 FROM walk JOIN edges ON src = id WHERE d < 4),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, path) AS k FROM walk)
    SELECT id, array_to_string(path, '>') AS path, len(list_filter(path, lambda x: x LIKE 's:%')) > 0 AND id LIKE 'o:%' AS partial FROM best WHERE k = 1""",
)
def grf12(spark, sf):
    return G.best_paths(statused(spark, sf), spark.range(1).select(F.lit("r:1").alias("id"))).select("id", F.array_join("path", ">").alias("path"), "partial")


@query("grf13_unique_paths", PATHS + " SELECT path[len(path)] AS id, any_value(array_to_string(path, '>')) AS path FROM done WHERE path[1] LIKE 'r:%' GROUP BY 1 HAVING count(*) = 1")
def grf13(spark, sf):
    """Orders that one path from all regions leads to: of all origins, one reaches it, and in one way."""
    ends = table(spark, sf, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"))
    regions = table(spark, sf, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    found = unique_search(star_rows(spark, sf), regions, ends, most_states=None)
    one = found.groupBy(F.col("end").alias("id")).agg(F.min("path").alias("path"), F.count("*").alias("n"), F.bool_and(F.col("result") == "unique").alias("sole"))
    return one.filter("n = 1 and sole").select("id", F.array_join("path", ">").alias("path"))


@query(
    "grf15_field_transitions",
    """WITH s AS (SELECT 'p:' || p_partkey AS id, [p_type, p_brand] AS field FROM part), r AS (SELECT DISTINCT 'p:' || l_partkey AS src, 'o:' || l_orderkey AS dst, CASE l_returnflag WHEN 'R' THEN 'alias' WHEN 'A' THEN 'read' ELSE 'opaque' END AS kind,
      CASE WHEN l_linestatus = 'O' THEN 'ECONOMY' ELSE 'SMALL' END AS segment FROM lineitem)
    SELECT src, dst AS id, kind, array_to_string(CASE WHEN kind = 'alias' THEN field WHEN kind = 'read' AND field[1] = segment THEN field[2:] END, '.') AS field,
      CASE WHEN kind = 'alias' OR (kind = 'read' AND field[1] = segment) THEN NULL WHEN kind = 'read' THEN 'field-mismatch' ELSE 'unsupported-relation' END AS stop, count(*) AS n FROM s JOIN r ON s.id = r.src GROUP BY ALL""",
)
def grf15(spark, sf):
    states = table(spark, sf, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.array("p_type", "p_brand").alias("field"))
    kind = F.when(F.col("l_returnflag") == "R", "alias").when(F.col("l_returnflag") == "A", "read").otherwise("opaque")
    segment = F.when(F.col("l_linestatus") == "O", "ECONOMY").otherwise("SMALL")
    rel = table(spark, sf, "lineitem").select(F.concat(F.lit("p:"), "l_partkey").alias("src"), F.concat(F.lit("o:"), "l_orderkey").alias("dst"), kind.alias("kind"), segment.alias("segment")).distinct()
    out = G.field_transitions(states, rel)
    kinds = F.when(F.col("stop") == "unsupported-relation", "opaque").when((F.col("stop") == "field-mismatch") | (F.size("field") == 1), "read").otherwise("alias")
    return out.select("src", "id", kinds.alias("kind"), F.array_join("field", ".").alias("field"), "stop").groupBy("src", "id", "kind", "field", "stop").agg(F.count("*").alias("n"))


@query(
    "grf20_same_name_ancestors",
    """WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS name, generate_subscripts(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1), 1) - 1 AS pos FROM pages),
    t AS (SELECT page_id, pos, lower(ltrim(name, '/')) AS tag, name[1] = '/' AS closing FROM found WHERE lower(ltrim(name, '/')) IN ('html','head','body','nav','ul','li','article','footer','div')),
    o AS (SELECT *, coalesce(sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM t)
    SELECT tag, count(*) AS elements, count(*) FILTER (WHERE open > 0) AS nested FROM o WHERE NOT closing GROUP BY tag""",
)
def grf20(spark, sf):
    rows = markup.tags(table(spark, sf, "pages")).filter(F.col("tag").isin(*markup.NESTED))
    before = W.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(before), F.lit(0))).filter("not closing")
    return rows.groupBy("tag").agg(F.count("*").alias("elements"), F.count_if(F.col("open") > 0).alias("nested"))


@query("agg31_chosen_sub_graph", PATHS + ", c AS (SELECT path FROM done ORDER BY len(path) DESC, path LIMIT 400), s AS (SELECT path, unnest(range(1, len(path))) AS i FROM c) SELECT path[i] AS src, path[i + 1] AS dst, count(*) AS paths, min(len(path) - i)::INTEGER AS min_depth FROM s GROUP BY 1, 2")
def agg31(spark, sf):
    return G.merged_steps(order_paths(spark, sf).orderBy(F.desc(F.size("path")), "path").limit(CHOSEN))


@query("win18_complex_trajectories", PATHS + " SELECT array_to_string(path, '>') AS path, len(path)::INTEGER AS length FROM done ORDER BY len(path) DESC, path LIMIT 400")
def win18(spark, sf):
    return longest_first(order_paths(spark, sf), CHOSEN)


def longest_first(paths: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest paths, ties by their text: as text ``a:10>`` comes before ``a:1>``, as an array after it."""
    rows = paths.select(F.array_join("path", ">").alias("path"), F.size("path").alias("length"))
    return rows.orderBy(F.desc("length"), "path").limit(n)


# ---------------------------------------------------------------- ranks and choices

#: How many a stage of WIN-16 may give, and all stages together.
STAGE_CAPS = {1: 4, 2: 1, 3: 1, 4: 1, 5: 3, 6: 2, 7: 1}
STAGE_TOTAL = 8


@query(
    "win14_representatives_per_area",
    ALL + ", r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) AS k FROM ordered) SELECT file, sink_id, CASE WHEN k = 1 THEN 0 ELSE 1 END AS tier FROM r ORDER BY tier, rank LIMIT 400",
)
def win14(spark, sf):
    return R.firsts_first(M.Report(spark, sf).ranked(), CHOSEN).select("file", "sink_id", "tier")


@query(
    "win16_staged_choice",
    """WITH c AS (SELECT o_custkey AS route, l_linenumber AS stage, l_suppkey AS identity, l_quantity, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS confidence, l_orderkey AS item
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    d AS (SELECT DISTINCT ON (route, stage, identity) * FROM c ORDER BY route, stage, identity, l_quantity DESC, confidence DESC, item),
    s AS (SELECT *, row_number() OVER (PARTITION BY route, stage ORDER BY l_quantity DESC, confidence DESC, item) AS k FROM d),
    n AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY stage, k) AS place FROM s WHERE k <= CASE stage WHEN 1 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 7 THEN 1 ELSE 0 END),
    e AS (SELECT o_custkey AS route, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS item FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT n.route, n.place::INTEGER AS place, n.stage, n.item FROM n LEFT JOIN e ON e.route = n.route WHERE n.place <= CASE WHEN e.route IS NULL THEN 8 ELSE 7 END
    UNION ALL SELECT e.route, (SELECT least(8, count(*) + 1) FROM n WHERE n.route = e.route)::INTEGER, NULL, e.item FROM e""",
)
def win16(spark, sf):
    """Routes are customers, stages line numbers, sources suppliers; a customer's greatest finished order comes last."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("route"), "o_orderstatus", "o_totalprice")
    rows = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    confidence = F.when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    rows = rows.select("route", F.col("l_linenumber").alias("stage"), F.col("l_suppkey").alias("identity"), "l_quantity", confidence.alias("confidence"), F.col("l_orderkey").alias("item"))
    last = orders.filter("o_orderstatus = 'F'").groupBy("route").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("item"))
    order = [F.desc("l_quantity"), F.desc("confidence"), F.asc("item")]
    return R.staged_choice(rows, last, "route", "stage", "identity", order, STAGE_CAPS, STAGE_TOTAL).select("route", "place", "stage", "item")


@query("win17_route_terminals", ALL + " SELECT component, sink_id, place FROM (SELECT component, sink_id, row_number() OVER (PARTITION BY component ORDER BY merge_width DESC, n DESC, seq) AS place FROM ranked) WHERE place <= 4")
def win17(spark, sf):
    place = F.row_number().over(W.partitionBy("component").orderBy(F.desc("merge_width"), F.desc("maximum_path_depth"), "seq"))
    return M.Report(spark, sf).ranked().withColumn("place", place).filter("place <= 4").select("component", "sink_id", "place")


@query(
    "join16_prefer_complete",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'N' THEN 0 ELSE 1 END, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1",
)
def join16(spark, sf):
    """JOIN-16: of several candidates at one place the complete one is preferred, then the least."""
    best = F.min_by("l_partkey", F.struct(F.when(F.col("l_returnflag") == "N", 0).otherwise(1), F.col("l_partkey"), F.col("l_suppkey")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(best.alias("l_partkey"))


@query(
    "join18_exactly_one",
    "SELECT c_custkey, CASE WHEN count(o_orderkey) = 1 THEN min(o_orderkey) END AS o_orderkey, CASE WHEN count(o_orderkey) = 1 THEN 'available' ELSE 'unavailable' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000 GROUP BY c_custkey",
)
def join18(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 400000")
    rows = table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("k"))
    one = F.col("n") == 1
    return rows.select("c_custkey", F.when(one, F.col("k")).alias("o_orderkey"), F.when(one, "available").otherwise("unavailable").alias("state"))


@query(
    "join23_trajectory_sources",
    BASE + ", w AS (SELECT i.sink_id, 'part.' || part AS source FROM items i WHERE guarded UNION SELECT i.sink_id, 'supplier.' || supplier FROM items i WHERE kind = 'unknown') SELECT source, count(*) AS trajectories, min(sink_id) AS first_sink FROM w GROUP BY source",
)
def join23(spark, sf):
    it = star.items(spark, sf)
    a = it.filter("guarded").select("sink_id", F.concat(F.lit("part."), "part").alias("source"))
    b = it.filter("kind = 'unknown'").select("sink_id", F.concat(F.lit("supplier."), "supplier").alias("source"))
    return a.union(b).distinct().groupBy("source").agg(F.count("*").alias("trajectories"), F.min("sink_id").alias("first_sink"))


@query(
    "set8_content_ids",
    "SELECT key, min(seq) AS first_seq, count(*) AS n FROM (SELECT o_custkey || ':' || o_orderstatus || ':' || o_orderpriority AS key, o_orderkey AS seq FROM orders) GROUP BY key",
)
def set8(spark, sf):
    """SET-8: one row per content, first wins; the 32-bit id stands next to the full key, which decides."""
    key = F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf, "orders").groupBy(key.alias("key")).agg(F.min("o_orderkey").alias("first_seq"), F.count("*").alias("n"))


@query(
    "cls22_roles",
    BASE + " SELECT sink_id, pos, CASE kind WHEN 'call' THEN 'origin' WHEN 'object-pack' THEN 'terminal' WHEN 'unknown' THEN 'boundary' ELSE 'step' END AS role, CASE WHEN kind = 'unknown' THEN 'unsupported' WHEN verdict = 'unknown' THEN 'partial' ELSE 'proven' END AS status, CASE kind WHEN 'unknown' THEN 2000 WHEN 'call' THEN 4080 WHEN 'object-pack' THEN 3080 ELSE 80 END AS priority FROM items",
)
def cls22(spark, sf):
    """CLS-22, CLS-25 and GRF-3: roles, status and frontier priority of elements."""
    it = star.items(spark, sf)
    pos = F.row_number().over(W.partitionBy("sink_id").orderBy("item"))
    k = F.col("kind")
    role = F.when(k == "call", "origin").when(k == "object-pack", "terminal").when(k == "unknown", "boundary").otherwise("step")
    status = F.when(k == "unknown", "unsupported").when(F.col("verdict") == "unknown", "partial").otherwise("proven")
    priority = F.when(k == "unknown", 2000).when(k == "call", 4080).when(k == "object-pack", 3080).otherwise(80)
    return it.select("sink_id", pos.alias("pos"), role.alias("role"), status.alias("status"), priority.alias("priority"))


@query(
    "flt7_hidden_components",
    "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '5$') AND (regexp_matches(c_name, '[12][0-9]$') OR regexp_matches(c_name, '^Customer#0*7'))",
)
def flt7(spark, sf):
    """FLT-7: exclusions first, then the first inclusion that matches."""
    name = F.col("c_name")
    rules = F.array(*[F.struct(F.lit(i).alias("i"), name.rlike(r).alias("hit")) for i, r in enumerate(("[12][0-9]$", "^Customer#0*7"))])
    first = F.try_element_at(F.filter(rules, lambda r: r["hit"]), F.lit(1))
    return table(spark, sf, "customer").filter(~name.rlike("5$") & first.isNotNull()).select("c_custkey")


@query("flt16_folder_map", BASE + """, e AS (SELECT DISTINCT a.n_name AS x, b.n_name AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey),
    own AS (SELECT n_name FROM nation WHERE n_regionkey = 2) SELECT n_name AS area, true AS inside FROM own UNION SELECT y, false FROM e WHERE x IN (SELECT n_name FROM own) AND y NOT IN (SELECT n_name FROM own)""")
def flt16(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    src = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("x"), F.col("n_regionkey").alias("rx"))
    dst = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("y"), F.col("n_regionkey").alias("ry"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    e = li.join(src.filter("rx = 2"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(dst.filter("ry <> 2"), F.col("o_custkey") == F.col("c_custkey"))
    return n.filter("n_regionkey = 2").select(F.col("n_name").alias("area"), F.lit(True).alias("inside")).union(e.select("y", F.lit(False)).distinct())


@query("fn26_span_and_delta", "SELECT o_orderkey, o_orderkey % 7 * 1000000 + o_custkey % 90 AS span, CASE WHEN abs(o_totalprice / 500000 - 0.5) < 0.001 THEN 'same' WHEN o_totalprice / 500000 < 0.5 THEN 'improved' ELSE 'regressed' END AS delta FROM orders")
def fn26(spark, sf):
    span = F.col("o_orderkey") % 7 * 1_000_000 + F.col("o_custkey") % 90
    return table(spark, sf, "orders").select("o_orderkey", span.alias("span"), T.delta_label(F.lit(0.5), F.col("o_totalprice") / 500000).alias("delta"))
