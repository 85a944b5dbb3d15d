"""Queries over evidence: calls and definitions, anchors, ancestry, closures, validation of records, verdict texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators.ranking import CHOSEN
from ..sources import markup, star
from ..sources.tables import table
from .markup import NESTED, TAGS
from .registry import query
from .related import GRAPH, star_edges
from .star_sql import ALL, BASE

# ---------------------------------------------------------------- joins


@query(
    "join9_calls_of_functions",
    "SELECT s_suppkey, s_name, count(*) AS calls, count(DISTINCT l_orderkey) AS callers, min(l_orderkey) AS first_caller FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal > 5000 GROUP BY ALL",
)
def join9(spark, sf):
    """Functions are chosen by name first; only their call sites are joined."""
    f = table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_suppkey", "s_name")
    calls = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))
    rows = calls.join(f, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey", "s_name")
    return rows.agg(F.sum("n").alias("calls"), F.count("*").alias("callers"), F.min("l_orderkey").alias("first_caller"))


@query(
    "join11_context_relay",
    BASE
    + """, c AS (SELECT s.component, s.file, i.expression, count(*) AS reads FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'call' GROUP BY ALL)
    SELECT a.component AS parent, b.component AS child, a.file, count(*) AS shared, sum(least(a.reads, b.reads))::BIGINT AS props, (3 * count(*) + sum(least(a.reads, b.reads)))::BIGINT AS score
    FROM c a JOIN c b ON a.file = b.file AND a.expression = b.expression AND a.component < b.component GROUP BY ALL""",
)
def join11(spark, sf):
    """CTX relay: pairs of components of a file that share read expressions, 3 points for each and one for every passed prop."""
    from ..functions.scores import relay_score

    r = M.Report(spark, sf)
    c = r.items.filter("kind = 'call'").join(r.sinks.select("sink_id", "component", "file"), "sink_id").groupBy("component", "file", "expression").agg(F.count("*").alias("reads"))
    a = c.withColumnsRenamed({"component": "parent", "reads": "ra"})
    b = c.withColumnsRenamed({"component": "child", "reads": "rb"})
    rows = a.join(b, ["file", "expression"]).filter("parent < child").groupBy("parent", "child", "file")
    return rows.agg(F.count("*").alias("shared"), F.sum(F.least("ra", "rb")).alias("props")).withColumn("score", relay_score(F.col("shared"), F.col("props")))


@query(
    "join13_context_channels",
    """WITH e AS (SELECT *, user_id || ':' || hour(ts) AS channel FROM events), p AS (SELECT channel, event_id FROM e WHERE event_type = 'signup'), sole AS (SELECT channel FROM p GROUP BY channel HAVING count(*) = 1)
    SELECT p.channel, p.event_id AS provider, c.event_id AS consumer FROM p JOIN sole USING (channel) JOIN e c ON c.channel = p.channel AND c.event_type = 'purchase'""",
)
def join13(spark, sf):
    e = table(spark, sf, "events").withColumn("channel", F.concat_ws(":", "user_id", F.hour("ts")))
    p = e.filter("event_type = 'signup'").select("channel", F.col("event_id").alias("provider"))
    sole = p.groupBy("channel").agg(F.count("*").alias("n"), F.min("provider").alias("provider")).filter("n = 1").drop("n")
    c = e.filter("event_type = 'purchase'").select("channel", F.col("event_id").alias("consumer"))
    return sole.join(c, "channel").select("channel", "provider", "consumer")


@query(
    "join17_anchor_on_span",
    "SELECT a.l_orderkey, a.l_linenumber, count(*) AS anchors FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity = b.l_quantity AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_partkey <> b.l_partkey GROUP BY ALL",
)
def join17(spark, sf):
    """Exact match on five columns, self excluded: counted by span, so no pair is built."""
    span = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    per = table(spark, sf, "lineitem").groupBy(*span, "l_partkey").agg(F.count("*").alias("n"))
    rows = per.groupBy(*span).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"))
    pairs = F.col("all") * F.col("all") - F.col("own")
    return rows.withColumn("p", pairs).filter("p > 0").groupBy("l_orderkey", "l_linenumber").agg(F.sum("p").cast("long").alias("anchors"))


@query(
    "join24_handed_off_sources",
    """WITH w AS (SELECT l_orderkey AS consumer, l_partkey AS source, max(l_discount) AS d, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)
    SELECT consumer, source, CASE WHEN n = 1 THEN 'only source' ELSE 'field match' END AS why FROM w WHERE n = 1 OR d >= 0.095""",
)
def join24(spark, sf):
    w = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("consumer"), F.col("l_partkey").alias("source")).agg(F.max("l_discount").alias("d"))
    w = w.withColumn("n", F.count("*").over(W.partitionBy("consumer"))).filter("n = 1 or d >= 0.095")
    return w.select("consumer", "source", F.when(F.col("n") == 1, "only source").otherwise("field match").alias("why"))


# ---------------------------------------------------------------- graphs


@query("grf10_import_closure", GRAPH + ", e AS (SELECT * FROM edges WHERE src NOT LIKE 'p:%' AND dst NOT LIKE 'o:%'), walk(id, d) AS (SELECT DISTINCT src, 0 FROM e WHERE src LIKE 'r:%' UNION SELECT e.dst, d + 1 FROM walk JOIN e ON e.src = id WHERE d < 5) SELECT id, min(d)::INTEGER AS distance FROM walk GROUP BY id")
def grf10(spark, sf):
    e = star_edges(spark, sf).filter("src not like 'p:%' and dst not like 'o:%'")
    return G.levels(e, table(spark, sf, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id")))


@query("grf21_ancestry", TAGS + f""", e AS (SELECT *, (SELECT max(p.pos) FROM tags p WHERE NOT p.closing AND p.page_id = t.page_id AND p.pos < t.pos AND p.level = t.level - 1 AND p.tag IN {NESTED}) AS parent FROM tags t WHERE NOT closing AND tag IN ('li', 'ul', 'nav', 'body', 'html'))
    SELECT e.page_id, e.pos, e.tag, p.tag AS parent_tag, g.tag AS grandparent_tag FROM e LEFT JOIN tags p ON p.page_id = e.page_id AND p.pos = e.parent
    LEFT JOIN e pe ON pe.page_id = e.page_id AND pe.pos = e.parent LEFT JOIN tags g ON g.page_id = e.page_id AND g.pos = pe.parent WHERE e.tag = 'li'""")
def grf21(spark, sf):
    e = markup.elements(table(spark, sf, "pages"))
    up = e.select("page_id", F.col("pos").alias("parent"), F.col("tag").alias("parent_tag"), F.col("parent").alias("above"))
    top = e.select("page_id", F.col("pos").alias("above"), F.col("tag").alias("grandparent_tag"))
    rows = e.filter("tag = 'li'").join(up, ["page_id", "parent"], "left").join(top, ["page_id", "above"], "left")
    return rows.select("page_id", "pos", "tag", "parent_tag", "grandparent_tag")


@query("grf24_gaps_in_slice", BASE + " SELECT s.file, count(*) AS gaps FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'unknown' AND s.sink_id IN (SELECT sink_id FROM defenses WHERE verdict = 'impossible') GROUP BY s.file")
def grf24(spark, sf):
    r = M.Report(spark, sf)
    inside = r.defenses.filter("verdict = 'impossible'").select("sink_id")
    return r.items.filter("kind = 'unknown'").join(inside, "sink_id", "left_semi").join(r.sinks.select("sink_id", "file"), "sink_id").groupBy("file").agg(F.count("*").alias("gaps"))


@query("grf26_truncation_frontiers", BASE + ", u AS (SELECT sink_id, min(pos) AS stop FROM items WHERE kind = 'unknown' GROUP BY sink_id) SELECT sink_id, stop, 'evidence-truncated' AS reason FROM u ORDER BY sink_id LIMIT 256")
def grf26(spark, sf):
    pos = F.row_number().over(W.partitionBy("sink_id").orderBy("item"))
    rows = star.items(spark, sf).withColumn("pos", pos).filter("kind = 'unknown'").groupBy("sink_id").agg(F.min("pos").alias("stop"))
    return rows.withColumn("reason", F.lit("evidence-truncated")).orderBy("sink_id").limit(256)


@query(
    "grf16_transfer_sequences",
    BASE + ", q AS (SELECT sink_id, string_agg(kind, '>' ORDER BY pos) AS steps FROM items GROUP BY sink_id) SELECT sink_id, steps, steps IN ('call', 'call>object-pack', 'object-pack>call', 'call>call') AS exact FROM q",
)
def grf16(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("item", "kind")))
    rows = star.items(spark, sf).groupBy("sink_id").agg(F.array_join(F.transform(ordered, lambda x: x["kind"]), ">").alias("steps"))
    return rows.withColumn("exact", F.col("steps").isin("call", "call>object-pack", "object-pack>call", "call>call"))


@query("grf9_canonical_nodes", BASE + " SELECT sink_id, coalesce(nullif(expression, 'd7'), guard_key) AS node, count(*) AS n FROM items WHERE guarded GROUP BY ALL")
def grf9(spark, sf):
    node = F.coalesce(F.nullif(F.col("expression"), F.lit("d7")), F.col("guard_key"))
    return star.items(spark, sf).filter("guarded").groupBy("sink_id", node.alias("node")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- validation and texts


@query(
    "val2_foreign_keys",
    """SELECT 'lineitem.part' AS link, count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'order.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'order.lineitem', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def val2(spark, sf):
    def missing(link: str, a: str, x: str, b: str, y: str) -> DataFrame:
        gone = table(spark, sf, a).join(table(spark, sf, b).select(F.col(y).alias("_k")), F.col(x) == F.col("_k"), "left_anti")
        return gone.agg(F.count("*").alias("missing")).select(F.lit(link).alias("link"), "missing")

    return (
        missing("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey")
        .union(missing("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"))
        .union(missing("order.customer", "orders", "o_custkey", "customer", "c_custkey"))
        .union(missing("order.lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"))
    )


@query(
    "val7_record_agreement",
    BASE + " SELECT sink_id, count(*) = max(pos) AS counts_agree, bool_and(pos >= 1) AS positions_ok FROM items GROUP BY sink_id",
)
def val7(spark, sf):
    rows = star.steps(spark, sf).groupBy("sink_id")
    return rows.agg((F.count("*") == F.max("pos")).alias("counts_agree"), F.bool_and(F.col("pos") >= 1).alias("positions_ok"))


@query(
    "cls7_defense_actions",
    BASE
    + """ SELECT verdict, origin, count(*) AS guards, CASE WHEN verdict = 'impossible' AND origin NOT IN ('parser-boundary', 'optional chain') THEN 'delete' WHEN verdict = 'impossible' THEN 'keep at the boundary'
    WHEN origin = 'nullable value' THEN 'tighten the type' WHEN verdict = 'unknown' THEN 'narrow first' ELSE 'keep' END AS action FROM defenses GROUP BY ALL""",
)
def cls7(spark, sf):
    v, o = F.col("verdict"), F.col("origin")
    action = (
        F.when((v == "impossible") & ~o.isin("parser-boundary", "optional chain"), "delete")
        .when(v == "impossible", "keep at the boundary")
        .when(o == "nullable value", "tighten the type")
        .when(v == "unknown", "narrow first")
        .otherwise("keep")
    )
    return star.defenses(spark, sf).groupBy("verdict", "origin").agg(F.count("*").alias("guards")).withColumn("action", action)


@query("cls20_stop_gate", ALL + " SELECT component, count(*) FILTER (WHERE tier = 'finding') AS findings, CASE WHEN round(max(burden), 9) < 0.75 AND count(*) FILTER (WHERE impossible > 0) = 0 THEN 'stop' WHEN max(reach) <= 3 THEN 'local only' ELSE 'go on' END AS advice FROM ranked GROUP BY component")
def cls20(spark, sf):
    rows = M.Report(spark, sf).ranked().groupBy("component")
    a = rows.agg(F.count_if(F.col("tier") == "finding").alias("findings"), F.round(F.max("burden"), 9).alias("b"), F.count_if(F.col("impossible_defense_count") > 0).alias("i"), F.max("reachable_sinks").alias("r"))
    return a.select("component", "findings", F.when((F.col("b") < 0.75) & (F.col("i") == 0), "stop").when(F.col("r") <= 3, "local only").otherwise("go on").alias("advice"))


@query("fn13_collapse", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(text) - length(replace(text, chr(10), '')) AS breaks FROM benchmark")
def fn13(spark, sf):
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return table(spark, sf, "benchmark").select("item_id", T.collapse(F.col("text")).alias("text"), breaks.cast("long").alias("breaks"))


@query("fn14_focus_snippet", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN replace(p_name, 'ring', '«ring»') ELSE p_name END AS focus FROM part")
def fn14(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n.contains("ring"), F.replace(n, F.lit("ring"), F.lit("«ring»"))).otherwise(n).alias("focus"))


@query("fn25_index_segments", r"SELECT event_id, props, regexp_matches(regexp_extract(props, '(\d+)', 1), '^(0|[1-9]\d*)$') AS is_index FROM events")
def fn25(spark, sf):
    return table(spark, sf, "events").select("event_id", "props", T.is_index(F.regexp_extract("props", r"(\d+)", 1)).alias("is_index"))


@query("fn19_attribute_names", BASE + r" SELECT sink_id, nullif(regexp_extract(label, '^([A-Za-z0-9_-]+)=\{', 1), '') AS attribute FROM sinks")
def fn19(spark, sf):
    from ..functions.classify import attribute

    return star.sinks(spark, sf).select("sink_id", attribute(F.col("label")).alias("attribute"))


@query("win20_junction_ranking", BASE + ", h AS (SELECT supplier, count(DISTINCT part) AS in_sources, count(DISTINCT sink_id) AS callers FROM items GROUP BY 1) SELECT supplier, in_sources * greatest(1, callers) AS weight, CASE WHEN in_sources >= 3 AND callers >= 2 THEN 'junction' ELSE 'confluence' END AS kind FROM h")
def win20(spark, sf):
    h = star.items(spark, sf).groupBy("supplier").agg(F.count_distinct("part").alias("in_sources"), F.count_distinct("sink_id").alias("callers"))
    kind = F.when((F.col("in_sources") >= 3) & (F.col("callers") >= 2), "junction").otherwise("confluence")
    return h.select("supplier", (F.col("in_sources") * F.greatest(F.lit(1).cast("long"), F.col("callers"))).alias("weight"), kind.alias("kind"))


@query("win15_area_selection", ALL + """, a AS (SELECT file, sum(reach)::BIGINT AS volume, count(*) AS n FROM ranked GROUP BY file), s AS (SELECT *, row_number() OVER (ORDER BY volume DESC, file) AS by_volume, row_number() OVER (ORDER BY n DESC, file) AS by_count FROM a)
    SELECT file, least(2 * by_volume - 1, 2 * by_count)::BIGINT AS turn FROM s ORDER BY turn LIMIT 400""")
def win15(spark, sf):
    """Two rankings are read in turns: the first takes odd turns, the second even ones.  Areas are files: few rows."""
    a = M.Report(spark, sf).ranked().groupBy("file").agg(F.sum("reachable_sinks").alias("volume"), F.count("*").alias("n"))
    by_volume = a.orderBy(F.desc("volume"), "file").limit(CHOSEN).withColumn("turn", 2 * F.row_number().over(W.orderBy(F.desc("volume"), "file")) - 1)
    by_count = a.orderBy(F.desc("n"), "file").limit(CHOSEN).withColumn("turn", 2 * F.row_number().over(W.orderBy(F.desc("n"), "file")))
    rows = by_volume.select("file", "turn").union(by_count.select("file", "turn")).groupBy("file").agg(F.min("turn").cast("long").alias("turn"))
    return rows.orderBy("turn").limit(CHOSEN)


@query("set1_first_seen_unique", BASE + " SELECT label, min(sink_id) AS first_seen FROM owned GROUP BY label")
def set1(spark, sf):
    return M.actionable(star.roots(spark, sf)).groupBy("label").agg(F.min("sink_id").alias("first_seen"))


@query("set7_trajectory_dedupe", BASE + ", q AS (SELECT sink_id, string_agg(kind, '>' ORDER BY pos) AS steps FROM items GROUP BY sink_id) SELECT steps, count(*) AS trajectories, min(sink_id) AS kept FROM q GROUP BY steps")
def set7(spark, sf):
    return grf16(spark, sf).groupBy("steps").agg(F.count("*").alias("trajectories"), F.min("sink_id").alias("kept"))


@query("src7_source_list", "SELECT s_nationkey AS place FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
def src7(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("place"))
    return a.union(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_nationkey")).distinct()
