"""Queries over pages (markup as source text), documents as files, and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import markup
from ..sources.tables import table
from ..streaming import windows
from .registry import query

NESTED = "('html','head','body','nav','ul','li','article','footer','div')"
TAGS = rf"""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1)) AS name, generate_subscripts(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1), 1) - 1 AS pos FROM pages),
    named AS (SELECT page_id, pos::INTEGER AS pos, lower(ltrim(name, '/')) AS tag, name[1] = '/' AS closing FROM found),
    tags AS (SELECT *, coalesce(sum(CASE WHEN tag IN {NESTED} THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS level FROM named)"""
ATTRS = r"""WITH attrs AS (SELECT page_id, unnest(regexp_extract_all(html, '\s([a-zA-Z-]+)="[^"]*"', 1)) AS name FROM pages)"""


@query("ext1_attribute_sinks", ATTRS + " SELECT page_id, name, CASE WHEN regexp_matches(name, '^on[A-Z]') THEN 'event-handler' WHEN name IN ('style', 'class') THEN 'style' WHEN name IN ('when', 'each', 'fallback') THEN 'render-control' ELSE 'attribute' END AS category, count(*) AS sinks FROM attrs GROUP BY ALL")
def ext1(spark, sf):
    return markup.attributes(table(spark, sf, "pages")).groupBy("page_id", "name", "category").agg(F.count("*").alias("sinks"))


@query("ext36_render_tree", TAGS + f", e AS (SELECT * FROM tags WHERE NOT closing) SELECT page_id, pos, tag, level, (SELECT max(p.pos) FROM e p WHERE p.page_id = e.page_id AND p.pos < e.pos AND p.level = e.level - 1 AND p.tag IN {NESTED}) AS parent FROM e")
def ext36(spark, sf):
    return markup.elements(table(spark, sf, "pages"))


@query("agg19_component_refs", TAGS + ", e AS (SELECT tag, page_id, pos, row_number() OVER (PARTITION BY tag ORDER BY page_id, pos) AS k FROM tags WHERE NOT closing) SELECT tag, count(*) AS uses, count(DISTINCT page_id) AS pages, string_agg(page_id || ':' || pos, ',' ORDER BY page_id, pos) FILTER (WHERE k <= 25) AS first_uses FROM e GROUP BY tag")
def agg19(spark, sf):
    rows = markup.tags(table(spark, sf, "pages")).filter("not closing")
    total = rows.groupBy("tag").agg(F.count("*").alias("uses"), F.count_distinct("page_id").alias("pages"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("tag").orderBy("page_id", "pos"))).filter("k <= 25")
    first = first.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("page_id", "pos"))).alias("u"))
    return total.join(first, "tag").select("tag", "uses", "pages", F.array_join(F.transform("u", lambda x: F.concat_ws(":", x["page_id"], x["pos"])), ",").alias("first_uses"))


@query(
    "join15_nearest_provider",
    TAGS + f""", e AS (SELECT * FROM tags WHERE NOT closing), link AS (SELECT * FROM e WHERE tag = 'a'), prov AS (SELECT * FROM e WHERE tag IN ('nav', 'article', 'footer', 'body'))
    SELECT l.page_id, l.pos, arg_max(p.tag, p.pos) AS provider FROM link l JOIN prov p ON p.page_id = l.page_id AND p.pos < l.pos AND p.level < l.level
      AND NOT EXISTS (SELECT 1 FROM tags c WHERE c.page_id = p.page_id AND c.closing AND c.tag = p.tag AND c.pos > p.pos AND c.pos < l.pos) GROUP BY l.page_id, l.pos""",
)
def join15(spark, sf):
    return nearest_provider(markup.tags(table(spark, sf, "pages")), "a", ("nav", "article", "footer", "body"))


def nearest_provider(tags: DataFrame, consumer: str, providers: tuple[str, ...]) -> DataFrame:
    """JOIN-15: for each consumer the innermost open provider.  Open ones are found by running counts, without a join."""
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    out = tags
    for p in providers:
        here = F.col("tag") == p
        out = out.withColumn(f"_open_{p}", F.coalesce(F.sum(F.when(here, F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)).over(before), F.lit(0)))
        out = out.withColumn(f"_last_{p}", F.max(F.when(here & ~F.col("closing"), F.col("pos"))).over(before))
    open_ = [F.when(F.col(f"_open_{p}") > 0, F.struct(F.col(f"_last_{p}").alias("at"), F.lit(p).alias("provider"))) for p in providers]
    rows = out.filter((F.col("tag") == consumer) & ~F.col("closing")).withColumn("best", F.array_max(F.array_compact(F.array(*open_))))
    return rows.filter("best is not null").select("page_id", "pos", F.col("best.provider").alias("provider"))


@query("agg32_shared_hubs", TAGS + ", e AS (SELECT tag, page_id FROM tags WHERE NOT closing) SELECT tag, count(DISTINCT page_id) AS incoming, regexp_matches(tag, '^(b|i|img|svg)$') AS is_icon FROM e GROUP BY tag HAVING count(DISTINCT page_id) > 5")
def agg32(spark, sf):
    rows = markup.tags(table(spark, sf, "pages")).filter("not closing").groupBy("tag")
    return rows.agg(F.count_distinct("page_id").alias("incoming")).filter("incoming > 5").withColumn("is_icon", F.col("tag").rlike("^(b|i|img|svg)$"))


@query("grf17_transparent_splice", TAGS + f""", e AS (SELECT *, (SELECT max(p.pos) FROM tags p WHERE NOT p.closing AND p.page_id = t.page_id AND p.pos < t.pos AND p.level = t.level - 1 AND p.tag IN {NESTED}) AS parent FROM tags t WHERE NOT closing)
    SELECT e.page_id, e.pos, e.tag, CASE WHEN p.tag = 'li' THEN p.parent ELSE e.parent END AS parent FROM e LEFT JOIN e p ON p.page_id = e.page_id AND p.pos = e.parent WHERE e.tag <> 'li'""")
def grf17(spark, sf):
    return splice(markup.elements(table(spark, sf, "pages")), "li")


def splice(elements: DataFrame, wrapper: str) -> DataFrame:
    """GRF-17: take a wrapper element out and attach its children to what holds it."""
    up = elements.filter(F.col("tag") == wrapper).select("page_id", F.col("pos").alias("parent"), F.col("parent").alias("above"), F.lit(True).alias("through"))
    rows = elements.filter(F.col("tag") != wrapper).join(up, ["page_id", "parent"], "left")
    return rows.select("page_id", "pos", "tag", F.when(F.col("through"), F.col("above")).otherwise(F.col("parent")).alias("parent"))


@query(
    "fn21_route_patterns",
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/\d+', '/:id', 'g') END AS pattern, length(path) - length(replace(path, '/', '')) AS depth FROM u""",
)
def fn21(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", F.when(F.col("path") == "", "/").otherwise(F.regexp_replace("path", r"/\d+", "/:id")).alias("pattern"), (F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))).cast("long").alias("depth"))


@query(
    "win25_route_atlas",
    r"""WITH u AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/\d+', '/:id', 'g') AS pattern, length(html) AS size FROM pages)
    SELECT pattern, count(*) AS pages, max(size) AS longest FROM u GROUP BY pattern ORDER BY longest DESC, pattern LIMIT 50""",
)
def win25(spark, sf):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""), r"/\d+", "/:id")
    rows = table(spark, sf, "pages").groupBy(path.alias("pattern")).agg(F.count("*").alias("pages"), F.max(F.char_length("html")).cast("long").alias("longest"))
    return rows.orderBy(F.desc("longest"), "pattern").limit(50)


@query(
    "src10_report_signals",
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs, contains(html, '<footer>') AS has_footer FROM pages""",
)
def src10(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"),
        F.col("html").contains("<footer>").alias("has_footer"),
    )


@query(
    "ext42_source_excerpts",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), h AS (SELECT doc_id, min(k) AS hit FROM l WHERE line LIKE '%token = %' GROUP BY doc_id)
    SELECT doc_id, hit::INTEGER AS hit, greatest(1, hit - 1)::INTEGER AS start, string_agg(line, chr(10) ORDER BY k) AS excerpt FROM l JOIN h USING (doc_id) WHERE k BETWEEN hit - 1 AND hit + 1 GROUP BY doc_id, hit""",
)
def ext42(spark, sf):
    return excerpts(table(spark, sf, "documents"), "token = ", 1)


def excerpts(docs: DataFrame, needle: str, around: int) -> DataFrame:
    """EXT-42: the first line that holds the needle, with the lines around it; the filter comes before the split."""
    rows = docs.filter(F.col("text").contains(needle)).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    hits = F.transform("lines", lambda x, i: F.when(x.contains(needle), i + 1))
    rows = rows.withColumn("hit", F.array_min(hits)).filter("hit is not null")
    start = F.greatest(F.lit(1), F.col("hit") - around)
    return rows.select("doc_id", "hit", start.alias("start"), F.array_join(F.slice("lines", start, F.col("hit") + around - start + 1), "\n").alias("excerpt"))


@query(
    "str1_event_windows",
    "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
)
def str1(spark, sf):
    rows = windows.run_windows(spark, sf).read()
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "events", "value")


@query(
    "agg35_context_consumers",
    """SELECT user_id, event_type, count(*) AS reads, array_to_string(list_sort(list_distinct(list(hour(ts)))), ',') AS hours, CASE min(CASE event_type WHEN 'error' THEN 0 ELSE 1 END) WHEN 0 THEN 'partial' ELSE 'proven' END AS status FROM events GROUP BY ALL""",
)
def agg35(spark, sf):
    hours = F.array_join(F.array_sort(F.collect_set(F.hour("ts"))).cast("array<string>"), ",")
    status = F.when(F.min(F.when(F.col("event_type") == "error", 0).otherwise(1)) == 0, "partial").otherwise("proven")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("reads"), hours.alias("hours"), status.alias("status"))


@query(
    "join25_read_resolution",
    """WITH s AS (SELECT event_id, user_id, event_type, ts, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS providers, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events)
    SELECT event_id, CASE WHEN providers = 0 THEN 'missing-provider' WHEN nearest IS NULL THEN 'boundary-gap' ELSE 'linked' END AS state FROM s WHERE event_type = 'purchase'""",
)
def join25(spark, sf):
    e = table(spark, sf, "events")
    own = W.partitionBy("user_id")
    before = own.orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    signup = F.col("event_type") == "signup"
    rows = e.select("event_id", "event_type", F.count(F.when(signup, 1)).over(own).alias("providers"), F.max(F.when(signup, F.col("ts"))).over(before).alias("nearest"))
    state = F.when(F.col("providers") == 0, "missing-provider").when(F.col("nearest").isNull(), "boundary-gap").otherwise("linked")
    return rows.filter("event_type = 'purchase'").select("event_id", state.alias("state"))


@query(
    "join10_tag_definitions",
    TAGS + ", u AS (SELECT page_id, tag, count(*) AS uses FROM tags WHERE NOT closing GROUP BY ALL), d AS (SELECT tag, min(page_id) AS defined FROM tags WHERE NOT closing GROUP BY tag) SELECT u.page_id, u.tag, uses, defined FROM u JOIN d USING (tag) WHERE u.page_id <> defined",
)
def join10(spark, sf):
    rows = markup.tags(table(spark, sf, "pages")).filter("not closing")
    uses = rows.groupBy("page_id", "tag").agg(F.count("*").alias("uses"))
    return uses.join(uses.groupBy("tag").agg(F.min("page_id").alias("defined")), "tag").filter("page_id <> defined").select("page_id", "tag", "uses", "defined")


@query(
    "set9_last_wins",
    "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
)
def set9(spark, sf):
    """SET-9: of several rows with one identity the last stays; WIN-11 is the same with min_by."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("win11_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def win11(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


@query("set10_proof_merge", "SELECT user_id, props AS identity, min(event_type) AS proof, count(*) AS proofs FROM events GROUP BY user_id, props HAVING count(DISTINCT event_type) = 1")
def set10(spark, sf):
    """SET-10: an identity counts only where all its proofs agree."""
    rows = table(spark, sf, "events").groupBy("user_id", F.col("props").alias("identity"))
    return rows.agg(F.min("event_type").alias("proof"), F.max("event_type").alias("other"), F.count("*").alias("proofs")).filter("proof = other").drop("other")


@query("fn31_json_fields", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def fn31(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


@query("agg30_omission_ledger", "SELECT event_type AS reason, props AS label, count(*) AS omitted, count(DISTINCT user_id) AS places FROM events GROUP BY ALL")
def agg30(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("reason"), F.col("props").alias("label")).agg(F.count("*").alias("omitted"), F.count_distinct("user_id").alias("places"))


@query("agg24_bridge_counts", "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS inbound, count(*) FILTER (WHERE event_type = 'purchase') AS outbound, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id")
def agg24(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(t.isin("click", "view")).alias("inbound"), F.count_if(t == "purchase").alias("outbound"), F.count_if(t == "error").alias("failed"))


@query("src5_ownership_routing", r"""WITH roots(root) AS (VALUES ('/en'), ('/fr'), ('/en/1'), ('/de'), ('/')), u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)
    SELECT page_id, arg_max(root, length(root)) AS owner FROM u JOIN roots ON starts_with(path, root) GROUP BY page_id""")
def src5(spark, sf):
    return owners(table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*", "").alias("path")), ["/en", "/fr", "/en/1", "/de", "/"])


def owners(files: DataFrame, roots: list[str]) -> DataFrame:
    """SRC-5: each file goes to the longest configured root that is a prefix of its path; the roots are a configuration."""
    hits = [F.when(F.startswith("path", F.lit(r)), F.lit(r)) for r in sorted(roots, key=len, reverse=True)]
    return files.withColumn("owner", F.coalesce(*hits)).filter("owner is not null").select("page_id", "owner")
