"""Queries of single filters, classifications, traversal steps and views that the other modules build on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators import ranking as R
from ..sources import markup, star
from ..sources.stored import stored
from ..sources.tables import table
from .markup import NESTED, TAGS
from .ranked import fan_out, r9
from .registry import query
from .related import GRAPH, star_edges
from .star_sql import ALL, BASE, MEASURED

@query("flt4_without_event_handlers", BASE + " SELECT category, count(*) AS sinks FROM sinks WHERE category <> 'event-handler' GROUP BY category")
def flt4(spark, sf):
    return star.sinks(spark, sf).filter("category <> 'event-handler'").groupBy("category").agg(F.count("*").alias("sinks"))


@query("flt6_relay_scope", BASE + ", c AS (SELECT DISTINCT s.component, s.file, i.expression FROM items i JOIN sinks s USING (sink_id) WHERE i.kind = 'call') SELECT component, file, count(*) AS relays FROM c WHERE contains(file, 'AFRICA') OR contains(expression, 'd1') GROUP BY ALL")
def flt6(spark, sf):
    r = M.Report(spark, sf)
    c = r.items.filter("kind = 'call'").join(r.sinks.select("sink_id", "component", "file"), "sink_id").select("component", "file", "expression").distinct()
    return c.filter(F.col("file").contains("AFRICA") | F.col("expression").contains("d1")).groupBy("component", "file").agg(F.count("*").alias("relays"))


POLICY = GRAPH + """, s AS (SELECT src, dst, CASE WHEN src LIKE 's:%' THEN 'partial' WHEN dst LIKE 's:%' AND hash_ok THEN 'proven' WHEN dst LIKE 's:%' THEN 'unsupported' ELSE 'proven' END AS status FROM (SELECT *, length(dst) % 2 = 0 AS hash_ok FROM edges) WHERE src NOT LIKE 'p:%'),
    walk(id, d) AS (SELECT 'r:2', 0 UNION SELECT dst, d + 1 FROM walk JOIN s ON src = id WHERE d < 4 AND status IN ('proven', 'partial')) SELECT id, min(d)::INTEGER AS distance FROM walk GROUP BY id"""


@query("flt9_accepted_relations", POLICY)
def flt9(spark, sf):
    """FLT-8 and FLT-9: only accepted statuses are followed; the predicate is on the edges, before the search."""
    e = star_edges(spark, sf).filter("src not like 'p:%'")
    status = F.when(F.col("src").startswith("s:"), "partial").when(F.col("dst").startswith("s:"), F.when(F.char_length("dst") % 2 == 0, "proven").otherwise("unsupported")).otherwise("proven")
    accepted = e.withColumn("status", status).filter(F.col("status").isin("proven", "partial"))
    return G.levels(accepted, spark.range(1).select(F.lit("r:2").alias("id")), 4)


@query("flt11_certainty_boundaries", BASE + " SELECT origin, count(*) AS guards FROM defenses WHERE regexp_matches(origin, 'parser-boundary|compatibility|optional|solid prop default|api-choice', 'i') GROUP BY origin")
def flt11(spark, sf):
    return star.defenses(spark, sf).filter(F.col("origin").rlike(classify.CERTAINTY)).groupBy("origin").agg(F.count("*").alias("guards"))


@query("flt12_actionable_pool", ALL + ", b AS (SELECT *, guards = 0 AND control = 0 AS background FROM ranked) SELECT sink_id FROM b WHERE NOT background OR NOT EXISTS (SELECT 1 FROM b WHERE NOT background)")
def flt12(spark, sf):
    rows = M.Report(spark, sf).ranked().withColumn("background", (F.col("defensive_operation_count") == 0) & (F.col("control_dependency_count") == 0))
    return R.actionable_pool(rows).select("sink_id")


@query("flt13_shared_sources", BASE + ", keyed AS (SELECT CASE WHEN kind = 'prop-read' THEN component || '::' || o.label ELSE o.label END AS key FROM owned o JOIN sinks s USING (sink_id)) SELECT count(*) AS sources, max(n) AS widest FROM (SELECT key, count(*) AS n FROM keyed GROUP BY key HAVING count(*) >= 2)")
def flt13(spark, sf):
    return fan_out(M.Report(spark, sf)).filter("total >= 2").agg(F.count("*").alias("sources"), F.max("total").alias("widest"))


@query("flt14_variant_gate", BASE + """ SELECT s.component, i.guard_key AS subject, count(*) AS sites FROM items i JOIN sinks s USING (sink_id) WHERE i.kind IN ('conditional', 'unknown') GROUP BY ALL
    HAVING count(*) >= 2 AND (count(DISTINCT i.origin) >= 2 OR count(*) FILTER (WHERE i.origin = 'parser-boundary') > 0)""")
def flt14(spark, sf):
    r = M.Report(spark, sf)
    rows = r.items.filter("kind in ('conditional', 'unknown')").join(r.sinks.select("sink_id", "component"), "sink_id").groupBy("component", F.col("guard_key").alias("subject"))
    out = rows.agg(F.count("*").alias("sites"), F.count_distinct("origin").alias("o"), F.count_if(F.col("origin") == "parser-boundary").alias("p"))
    return out.filter("sites >= 2 and (o >= 2 or p > 0)").select("component", "subject", "sites")


@query("cls3_background_penalty", MEASURED + """, t AS (SELECT sink_id, string_agg(label, ' ' ORDER BY pos) AS text, arg_max(k, pos) FILTER (WHERE k IN ('call', 'alias')) AS last_kind, arg_max(label, pos) FILTER (WHERE k IN ('call', 'alias')) AS last_label, bool_and(k <> 'object-pack') AS scalar
      FROM (SELECT sink_id, pos, CASE kind WHEN 'call' THEN 'call' WHEN 'object-pack' THEN 'object-pack' ELSE 'operation' END AS k, CASE WHEN p_size % 3 = 0 THEN 'width-' || p_size ELSE p_name || '-' || p_size END AS label FROM items JOIN part ON part = p_partkey) GROUP BY sink_id)
    SELECT sink_id, 0.35::DOUBLE AS penalty FROM t JOIN metrics m USING (sink_id) WHERE scalar AND guards = 0 AND impossible = 0 AND unknown = 0 AND n <= 7 AND churn = 0 AND merge_width <= 3 AND last_kind = 'call'
      AND regexp_matches(last_label, '^(has|show|is|axis|tick|title|label|inner|outer|start|end|x|y|width|height|left|right|top|bottom)', 'i')""")
def cls3(spark, sf):
    r = M.Report(spark, sf)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.concat_ws("-", F.when(F.col("p_size") % 3 == 0, "width").otherwise(F.col("p_name")), "p_size").alias("label"))
    kind = F.when(F.col("kind").isin("call", "object-pack"), F.col("kind")).otherwise("operation")
    ordered = F.array_sort(F.collect_list(F.struct("item", kind.alias("kind"), "label")))
    steps = r.items.join(part, "part").groupBy("sink_id").agg(F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"))).alias("steps"))
    rows = r.grounded().withColumn("pack_risk", F.lit(0)).join(steps, "sink_id")
    return rows.withColumn("penalty", classify.background(F.col("steps"), F.col)).filter("penalty is not null").select("sink_id", "penalty")


@query("cls5_nullish_verdicts", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN p_type LIKE '%SMALL%' THEN 'unknown' WHEN p_size % 5 = 0 THEN 'possible' ELSE 'impossible' END AS verdict FROM part) GROUP BY verdict")
def cls5(spark, sf):
    """CLS-5 and CLS-6 over type members: any makes it unknown, a nullish member possible, else impossible."""
    members = F.array(F.when(F.col("p_type").contains("SMALL"), "any"), F.when(F.col("p_size") % 5 == 0, "undefined"), F.lit("string"))
    verdict = F.when(F.array_contains(members, "any"), "unknown").when(F.exists(members, lambda m: F.coalesce(m.isin("null", "undefined"), F.lit(False))), "possible").otherwise("impossible")
    return table(spark, sf, "part").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("cls16_type_leaks", r"SELECT p_partkey, regexp_matches(t, '\b(any|unknown)\b') OR len(string_split(t, '|')) > 4 AS leak FROM (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'any' WHEN p_size % 7 = 0 THEN 'a|b|c|d|e' ELSE p_name END AS t FROM part)")
def cls16(spark, sf):
    t = F.when(F.col("p_size") % 9 == 0, "any").when(F.col("p_size") % 7 == 0, "a|b|c|d|e").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", classify.type_leak(t).alias("leak"))


@query("cls21_evidence_level", ALL + " SELECT sink_id, CASE WHEN impossible > 0 THEN 'proven-unnecessary' WHEN tier = 'finding' THEN 'suspicious-transformation' ELSE 'fact' END AS level FROM ranked")
def cls21(spark, sf):
    level = F.when(F.col("impossible_defense_count") > 0, "proven-unnecessary").when(F.col("tier") == "finding", "suspicious-transformation").otherwise("fact")
    return M.Report(spark, sf).ranked().select("sink_id", level.alias("level"))


@query("cls24_operation_kinds", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|nut') THEN 'parse' WHEN regexp_matches(p_name, 'bolt') THEN 'validate' WHEN regexp_matches(p_name, 'widget') THEN 'select' ELSE 'call' END AS operation FROM part")
def cls24(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.when(n.rlike("ring|nut"), "parse").when(n.rlike("bolt"), "validate").when(n.rlike("widget"), "select").otherwise("call").alias("operation"))


@query("cls26_candidates", ALL + " SELECT sink_id, (merge_width >= 2 AND suspicious > 0 AND guards = 0) AS mirror_risk, (reach >= 6 AND merge_width >= 2) AS provider_candidate, (churn >= 2) AS grouping_candidate FROM ranked")
def cls26(spark, sf):
    c = F.col
    return M.Report(spark, sf).ranked().select(
        "sink_id",
        ((c("merge_width") >= 2) & (c("suspicious_pack_count") > 0) & (c("defensive_operation_count") == 0)).alias("mirror_risk"),
        ((c("reachable_sinks") >= 6) & (c("merge_width") >= 2)).alias("provider_candidate"),
        (c("representation_churn") >= 2).alias("grouping_candidate"),
    )


@query("cls28_context_density", "SELECT user_id, CASE WHEN count(*) >= 80 THEN 'dense' WHEN count(*) >= 40 THEN 'medium' ELSE 'sparse' END AS density FROM events GROUP BY user_id")
def cls28(spark, sf):
    n = F.count("*")
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(n >= 80, "dense").when(n >= 40, "medium").otherwise("sparse").alias("density"))


@query("grf5_neighbours", GRAPH + ", n AS (SELECT dst AS id FROM edges WHERE src = 'n:3' UNION SELECT src FROM edges WHERE dst = 'n:3') SELECT id, CASE WHEN id LIKE 's:%' THEN 2000 WHEN id LIKE 'r:%' THEN 4000 ELSE 100 END AS priority FROM n")
def grf5(spark, sf):
    e = star_edges(spark, sf)
    ids = e.filter("src = 'n:3'").select(F.col("dst").alias("id")).union(e.filter("dst = 'n:3'").select("src")).distinct()
    return ids.withColumn("priority", F.when(F.col("id").startswith("s:"), 2000).when(F.col("id").startswith("r:"), 4000).otherwise(100))


@query("grf8_compacted_paths", BASE + ", q AS (SELECT sink_id, string_agg(kind, '>' ORDER BY pos) FILTER (WHERE kind <> 'conditional') AS path, count(*) FILTER (WHERE kind = 'conditional') AS dropped FROM items GROUP BY sink_id) SELECT sink_id, coalesce(path, '') AS path, dropped FROM q")
def grf8(spark, sf):
    """GRF-8: drop relay nodes from a path and keep the order of the rest."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item", "kind"))), lambda x: x["kind"])
    rows = star.items(spark, sf).groupBy("sink_id").agg(ordered.alias("p"))
    return rows.select("sink_id", F.array_join(F.filter("p", lambda k: k != "conditional"), ">").alias("path"), F.size(F.filter("p", lambda k: k == "conditional")).cast("long").alias("dropped"))


@query("grf27_condensed_wrappers", TAGS + f""", e AS (SELECT *, (SELECT max(p.pos) FROM tags p WHERE NOT p.closing AND p.page_id = t.page_id AND p.pos < t.pos AND p.level = t.level - 1 AND p.tag IN {NESTED}) AS parent FROM tags t WHERE NOT closing),
    up1 AS (SELECT e.page_id, e.pos, e.tag, CASE WHEN p.tag IN ('ul', 'li') THEN p.parent ELSE e.parent END AS parent FROM e LEFT JOIN e p ON p.page_id = e.page_id AND p.pos = e.parent),
    up2 AS (SELECT u.page_id, u.pos, u.tag, CASE WHEN p.tag IN ('ul', 'li') THEN p.parent ELSE u.parent END AS parent FROM up1 u LEFT JOIN e p ON p.page_id = u.page_id AND p.pos = u.parent)
    SELECT page_id, pos, tag, parent FROM up2 WHERE tag NOT IN ('ul', 'li')""")
def grf27(spark, sf):
    return condensed(markup.elements(table(spark, sf, "pages")), ("ul", "li"))


def condensed(elements: DataFrame, wrappers: tuple[str, ...]) -> DataFrame:
    """GRF-19/GRF-27: elements without wrappers, each under its nearest visible ancestor, through any number of wrappers."""
    elements = stored(elements, "elements")
    up = elements.filter(F.col("tag").isin(*wrappers)).select("page_id", F.col("pos").alias("parent"), F.col("parent").alias("_above"))
    open_, done = elements.filter(~F.col("tag").isin(*wrappers)).select("page_id", "pos", "tag", "parent"), []
    while True:
        done.append(open_.join(up, ["page_id", "parent"], "left_anti").select("page_id", "pos", "tag", "parent"))
        open_ = stored(open_.join(up, ["page_id", "parent"]).select("page_id", "pos", "tag", F.col("_above").alias("parent")), "open")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)


@query("grf23_relation_files", BASE + " SELECT 'part.' || part AS element, count(DISTINCT s.file) AS files FROM items i JOIN sinks s USING (sink_id) GROUP BY part")
def grf23(spark, sf):
    """GRF-23: which files can emit relations of each element."""
    r = M.Report(spark, sf)
    rows = r.items.join(r.sinks.select("sink_id", "file"), "sink_id")
    return rows.groupBy(F.concat(F.lit("part."), "part").alias("element")).agg(F.count_distinct("file").alias("files"))


@query("fn20_source_families", BASE + " SELECT 'part.' || (part % 10) AS family, count(DISTINCT part) AS sources FROM items GROUP BY 1")
def fn20(spark, sf):
    label = F.concat(F.lit("part."), (F.col("part") % 10).cast("string"), F.lit("."), F.col("part").cast("string"))
    return star.items(spark, sf).groupBy(T.source_family(label).alias("family")).agg(F.count_distinct("part").alias("sources"))


@query("fn23_stable_ids", BASE + """, k AS (SELECT sink_id, '{"category":"' || category || '","file":"' || file || '","line":"' || line || '"}' AS s FROM sinks) SELECT sink_id, s AS serial, lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296), 36)) AS id FROM k""")
def fn23(spark, sf):
    """FN-23: key-sorted serialization and its hash; the serial is kept, as 32 bits can collide."""
    serial = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.create_map(F.lit("line"), F.col("line").cast("string"), F.lit("file"), F.col("file"), F.lit("category"), F.col("category"))))))
    return star.sinks(spark, sf).select("sink_id", serial.alias("serial"), T.fnv1a36(serial).alias("id"))


@query("fn24_field_paths", "SELECT p_partkey, p_type || '[' || p_size || ']' || '[*]' || '[\"' || p_brand || '\"]' AS path FROM part")
def fn24(spark, sf):
    def segment(kind: str, value):
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    path = F.array(segment("property", F.col("p_type")), segment("index", F.col("p_size")), segment("any", F.lit("")), segment("key", F.col("p_brand")))
    return table(spark, sf, "part").select("p_partkey", T.field_path(path).alias("path"))


@query("win10_unit_pivots", BASE + ", p AS (SELECT DISTINCT s.file, o.label FROM owned o JOIN sinks s USING (sink_id)), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY label) AS n FROM p) SELECT file, string_agg(label, ',' ORDER BY label) AS pivots FROM k WHERE n <= 4 GROUP BY file")
def win10(spark, sf):
    r = M.Report(spark, sf)
    labels = M.actionable(r.roots).join(r.sinks.select("sink_id", "file"), "sink_id").select("file", "label").distinct()
    first = labels.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("label"))).filter("n <= 4")
    return first.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("pivots"))


@query("win21_inline_order", BASE + ", h AS (SELECT supplier, count(DISTINCT sink_id) AS callers FROM items GROUP BY 1) SELECT supplier, CASE WHEN callers <= 500 THEN 0 ELSE 1 END AS verdict_rank FROM h ORDER BY verdict_rank, supplier LIMIT 30")
def win21(spark, sf):
    h = star.items(spark, sf).groupBy("supplier").agg(F.count_distinct("sink_id").alias("callers"))
    return h.select("supplier", F.when(F.col("callers") <= 500, 0).otherwise(1).alias("verdict_rank")).orderBy("verdict_rank", "supplier").limit(30)


@query("win23_label_budget", BASE + " SELECT file, label, uses FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY uses DESC, label) AS k FROM (SELECT s.file, o.label, count(*) AS uses FROM owned o JOIN sinks s USING (sink_id) GROUP BY ALL)) WHERE k <= 8")
def win23(spark, sf):
    r = M.Report(spark, sf)
    uses = M.actionable(r.roots).join(r.sinks.select("sink_id", "file"), "sink_id").groupBy("file", "label").agg(F.count("*").alias("uses"))
    return uses.withColumn("k", F.row_number().over(W.partitionBy("file").orderBy(F.desc("uses"), "label"))).filter("k <= 8").drop("k")


@query("vw1_overview", ALL + " SELECT feature, count(*) AS sinks, count(DISTINCT file) AS files, round(max(burden), 9) AS worst, count(*) FILTER (WHERE tier = 'finding') AS findings, count(*) FILTER (WHERE unknown > 0) AS uncertain, count(*) FILTER (WHERE impossible > 0) AS removable FROM ranked GROUP BY feature")
def vw1(spark, sf):
    c = F.col
    return M.Report(spark, sf).ranked().groupBy("feature").agg(
        F.count("*").alias("sinks"), F.count_distinct("file").alias("files"), F.round(F.max("burden"), 9).alias("worst"), F.count_if(c("tier") == "finding").alias("findings"),
        F.count_if(c("unknown_edge_count") > 0).alias("uncertain"), F.count_if(c("impossible_defense_count") > 0).alias("removable"),
    )


@query("vw3_work_packets", ALL + " SELECT sink_id, file, shape, round(burden, 9) AS burden, CASE WHEN impossible > 0 THEN 'delete ' || impossible || ' guards' WHEN churn > 1 THEN 'merge ' || churn || ' packs' ELSE 'trace ' || n || ' steps' END AS advice FROM ordered WHERE rank <= 12")
def vw3(spark, sf):
    c = F.col
    advice = (
        F.when(c("impossible_defense_count") > 0, F.concat(F.lit("delete "), "impossible_defense_count", F.lit(" guards")))
        .when(c("representation_churn") > 1, F.concat(F.lit("merge "), "representation_churn", F.lit(" packs")))
        .otherwise(F.concat(F.lit("trace "), "maximum_path_depth", F.lit(" steps")))
    )
    return R.head(M.Report(spark, sf).ranked(), 12).select("sink_id", "file", "shape", r9("burden"), advice.alias("advice"))


@query("val4_sorted_positions", BASE + " SELECT sink_id, count(*) AS steps, count(DISTINCT kind) AS kinds, min(pos) = 1 AND max(pos) = count(*) AS continuous FROM items GROUP BY sink_id HAVING count(*) > 1")
def val4(spark, sf):
    rows = star.steps(spark, sf).groupBy("sink_id")
    return rows.agg(F.count("*").alias("steps"), F.count_distinct("kind").alias("kinds"), ((F.min("pos") == 1) & (F.max("pos") == F.count("*"))).alias("continuous")).filter("steps > 1")


@query("val5_bridge_ends", "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS unmatched FROM events GROUP BY event_type")
def val5(spark, sf):
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("ok"))
    rows = table(spark, sf, "events").join(known, "user_id", "left").groupBy("event_type")
    return rows.agg(F.count("*").alias("events"), F.count_if(F.col("ok").isNull()).alias("unmatched"))


@query("src12_text_by_path", "SELECT page_id, url, length(html) AS chars FROM pages WHERE length(url) <= 512 AND strlen(html) <= 4194304 AND contains(url, '/en/')")
def src12(spark, sf):
    rows = table(spark, sf, "pages").filter((F.char_length("url") <= 512) & (F.octet_length("html") <= 4 * 2**20) & F.col("url").contains("/en/"))
    return rows.select("page_id", "url", F.char_length("html").cast("long").alias("chars"))
