"""Queries of the bounded choices with several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choices
from ..sources.tables import table
from .registry import query
from .related import PATHS, order_paths

# ---------------------------------------------------------------- areas

#: Customers and suppliers are areas; an order's trajectory leads from its suppliers to its customer.
AREAS = """WITH li AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
    a AS (SELECT 'c:' || c_custkey AS id, 'area/c' || c_custkey AS path, count(*) FILTER (WHERE o_orderstatus = 'F') AS findings, count(o_orderkey) AS sinks, 0::BIGINT AS sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
      UNION ALL SELECT 's:' || s_suppkey, 'area/s' || s_suppkey, 0, 0, count(l_orderkey) FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey),
    t AS (SELECT o_orderkey AS id, o_totalprice AS burden, list_append(coalesce((SELECT list('s:' || l_suppkey ORDER BY l_suppkey) FROM li WHERE l_orderkey = o_orderkey), []), 'c:' || o_custkey) AS areas FROM orders)"""


def star_areas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    zero = F.lit(0).cast("long")
    c = table(spark, sf, "customer").select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    c = c.groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("findings"), F.count("o_orderkey").alias("sinks"))
    c = c.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.concat(F.lit("area/c"), "c_custkey").alias("path"), "findings", "sinks", zero.alias("sources"))
    s = table(spark, sf, "supplier").select("s_suppkey").join(li, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("sources"))
    s = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.concat(F.lit("area/s"), "s_suppkey").alias("path"), zero.alias("findings"), zero.alias("sinks"), "sources")
    by = li.groupBy(F.col("l_orderkey").alias("_order")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("_by"))
    t = orders.join(by, F.col("o_orderkey") == F.col("_order"), "left")
    steps = F.concat(F.transform(F.coalesce("_by", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("s:"), x)), F.array(F.concat(F.lit("c:"), "o_custkey")))
    return c.union(s), t.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("burden"), steps.alias("areas"))


@query(
    "win15_areas_by_tiers",
    AREAS
    + """, top AS (SELECT *, row_number() OVER (ORDER BY list_contains(areas, 'c:7') DESC, burden DESC, id) AS n FROM t QUALIFY n <= 400),
    so AS (SELECT id, row_number() OVER (ORDER BY findings DESC, sinks DESC, sources DESC, path) AS n FROM a WHERE sources > 0), si AS (SELECT id, row_number() OVER (ORDER BY findings DESC, sinks DESC, sources DESC, path) AS n FROM a WHERE sinks > 0),
    c AS (SELECT 'c:7' AS id, 0 AS tier, 0 AS x, 0 AS y UNION ALL SELECT unnest(areas), 1, n, generate_subscripts(areas, 1) FROM top UNION ALL SELECT id, 2, n, 0 FROM so UNION ALL SELECT id, 2, n, 1 FROM si
      UNION ALL SELECT id, 3, row_number() OVER (ORDER BY path), 0 FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, x, y) AS k FROM c WHERE id IN (SELECT id FROM a))
    SELECT a.id, path, findings, sinks, sources, tier FROM (SELECT id, tier FROM f WHERE k = 1 ORDER BY tier, x, y, id LIMIT 400) JOIN a USING (id)""",
)
def win15(spark, sf):
    """The choice around one customer."""
    return choices.select_areas(*star_areas(spark, sf), focus="c:7")


# ---------------------------------------------------------------- trajectories


@query(
    "win18_ranked_by_five_keys",
    PATHS
    + """, k AS (SELECT path, len(path)::INTEGER AS length, len(list_filter(path, lambda x: x LIKE 's:%' OR x LIKE 'p:%'))::INTEGER AS substitutions, path[1] LIKE 'r:%' AS complete, path[len(path)] AS terminal, array_to_string(path, '>') AS key FROM done)
    SELECT key, length, substitutions, complete, terminal FROM k ORDER BY length DESC, substitutions DESC, complete DESC, terminal, key LIMIT 400""",
)
def win18(spark, sf):
    """Steps of suppliers and parts are substitutions; a path from a region is complete."""
    p = order_paths(spark, sf)
    swapped = F.size(F.filter("path", lambda x: x.startswith("s:") | x.startswith("p:")))
    rows = p.select(
        F.array_join("path", ">").alias("key"), F.size("path").alias("length"), swapped.alias("substitutions"), F.element_at("path", 1).startswith("r:").alias("complete"), F.element_at("path", -1).alias("terminal")
    )
    return choices.complex_first(rows)


# ---------------------------------------------------------------- routes

#: Pages by their pattern are routes, hosts are sources.
ROUTES = r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/\d+', '/:id', 'g') AS pattern, regexp_extract(url, '^https?://([^/]*)', 1) AS host, length(html) AS size,
      len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<img ')) AS images FROM pages),
    r AS (SELECT pattern, CASE WHEN min(page_id) % 3 = 0 THEN 'api' ELSE 'page' END AS kind, 'page-' || min(page_id) AS file, list_sort(list(DISTINCT host)) AS sources, sum(size)::BIGINT AS total_steps, count(*) AS trajectories, max(size) AS unique_steps,
      sum(links)::BIGINT AS substitutions, sum(images)::BIGINT AS gaps FROM u GROUP BY pattern)"""


def star_routes(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""), r"/\d+", "/:id")
    rows = pages.select("page_id", path.alias("pattern"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.char_length("html").cast("long").alias("size"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<img ")).cast("long").alias("images"))
    first = F.min("page_id")
    hosts = F.transform(F.array_sort(F.collect_set("host")), lambda h: F.struct(h.alias("key"), h.alias("label")))
    return rows.groupBy("pattern").agg(
        F.when(first % 3 == 0, "api").otherwise("page").alias("kind"), F.concat(F.lit("page-"), first).alias("file"), hosts.alias("sources"), F.sum("size").alias("total_steps"), F.count("*").alias("trajectories"), F.max("size").alias("unique_steps"), F.sum("links").alias("substitutions"), F.sum("images").alias("gaps")
    )


def written(routes: DataFrame) -> DataFrame:
    return routes.withColumn("sources", F.array_join("sources.key", ","))


@query("win25_whole_atlas", ROUTES + " SELECT pattern, kind, file, array_to_string(sources, ',') AS sources, total_steps, trajectories, unique_steps, substitutions, gaps FROM r")
def win25_whole(spark, sf):
    return written(choices.route_atlas(star_routes(spark, sf)))


@query(
    "win25_filtered_atlas",
    ROUTES + " SELECT pattern, kind, file, array_to_string(sources, ',') AS sources, total_steps, trajectories, unique_steps, substitutions, gaps FROM r WHERE kind = 'page' AND contains(lower(pattern || ' ' || file || ' ' || array_to_string(sources, ' ')), 'e-1')",
)
def win25_filtered(spark, sf):
    return written(choices.route_atlas(star_routes(spark, sf), kind="page", sort="gaps", text=" E-1 ", source="no such host"))


# ---------------------------------------------------------------- sample of the graph


@query(
    "snk3_bounded_graph",
    """WITH e AS (SELECT o_orderkey AS seq, o_custkey || '>' || o_orderkey AS id FROM orders), n AS (SELECT c_custkey AS seq, 'c' || c_custkey AS id FROM customer)
    SELECT 'edge' AS part, seq, id, greatest((SELECT count(*) FROM e) - 500, 0) AS omitted FROM (SELECT * FROM e ORDER BY seq, id LIMIT 500)
    UNION ALL SELECT 'node', seq, id, greatest((SELECT count(*) FROM n) - 500, 0) FROM (SELECT * FROM n ORDER BY seq, id LIMIT 500)""",
)
def snk3(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat_ws(">", "o_custkey", "o_orderkey").alias("id"))
    return choices.bounded_graph(nodes, edges, 500)
