"""The star-as-program tables as SQL common table expressions, written apart from the DataFrame code they check."""

SINKS = """
sinks AS (
    SELECT o_orderkey AS seq, o_orderkey AS sink_id, 'src/' || r_name || '/' || n_name || '.tsx' AS file, r_name AS feature, c_mktsegment AS component,
           o_orderkey AS line, o_orderdate AS made, o_totalprice AS price, o_orderstatus = 'P' AS has_literal,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'rendered-value' WHEN '2-HIGH' THEN 'attribute' WHEN '3-MEDIUM' THEN 'style'
                WHEN '4-NOT SPECIFIED' THEN 'render-control' ELSE 'event-handler' END AS category,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'value.' || o_orderkey
                WHEN '2-HIGH' THEN (CASE o_orderkey % 4 WHEN 0 THEN 'width' WHEN 1 THEN 'id' WHEN 2 THEN 'x' ELSE 'class' END) || '={v}'
                WHEN '3-MEDIUM' THEN 'style={v}'
                WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'when={v}' ELSE 'each={v}' END
                ELSE 'onClick={v}' END AS label,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'text'
                WHEN '2-HIGH' THEN CASE o_orderkey % 4 WHEN 0 THEN 'svg-shell' WHEN 1 THEN 'identity' WHEN 2 THEN 'geometry' ELSE 'style' END
                WHEN '3-MEDIUM' THEN 'style' WHEN '4-NOT SPECIFIED' THEN 'control-flow' ELSE 'other' END AS family
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

ITEMS = """
items AS (
    SELECT l_orderkey AS sink_id, l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS price,
           CASE WHEN l_returnflag = 'R' THEN 'call' WHEN l_returnflag = 'A' THEN 'object-pack' WHEN l_tax >= 0.075 THEN 'unknown' ELSE 'conditional' END AS kind,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos,
           l_suppkey || ':' || l_linenumber AS guard_key, l_discount >= 0.075 AS guarded, 'd' || (l_partkey % 50) AS expression,
           CASE l_returnflag WHEN 'R' THEN 'impossible' WHEN 'A' THEN 'possible' ELSE 'unknown' END AS verdict,
           CASE WHEN l_linestatus = 'O' AND l_tax < 0.03 THEN 'optional chain' WHEN l_linestatus = 'O' THEN 'parser-boundary'
                WHEN l_returnflag = 'A' THEN 'nullable value' ELSE 'literal default' END AS origin
    FROM lineitem
)"""

DEFENSES = """
defenses AS (
    SELECT sink_id, guard_key, expression, verdict, origin, price
    FROM (SELECT *, row_number() OVER (PARTITION BY sink_id, guard_key ORDER BY pos) AS nth FROM items WHERE guarded) WHERE nth = 1
)"""

ROOTS = """
roots AS (
    SELECT DISTINCT sink_id, 'part.' || part AS label, CASE WHEN part % 2 = 0 THEN 'prop-read' ELSE 'source' END AS kind FROM items
    UNION ALL SELECT DISTINCT sink_id, 'supplier.' || supplier, 'parameter' FROM items
    UNION ALL SELECT sink_id, 'literal.P', 'literal' FROM sinks WHERE has_literal
), owned AS (
    SELECT * FROM roots WHERE kind IN ('prop-read', 'source')
)"""

METRICS = """
counted AS (
    SELECT sink_id, count(*) AS n, count(*) FILTER (WHERE kind = 'call') AS hops, count(*) FILTER (WHERE kind = 'conditional') AS control,
           count(*) FILTER (WHERE kind = 'unknown') AS unknown, count(DISTINCT part) FILTER (WHERE kind = 'object-pack') AS churn,
           count(DISTINCT part) AS parts, count(DISTINCT supplier) AS suppliers, count(DISTINCT part) FILTER (WHERE part % 2 = 0) AS props
    FROM items GROUP BY sink_id
), guards AS (
    SELECT sink_id, count(*) AS guards, count(*) FILTER (WHERE verdict = 'impossible') AS impossible, count(*) FILTER (WHERE verdict = 'unknown') AS loose,
           count(*) FILTER (WHERE origin IN ('optional chain', 'parser-boundary')) AS certain
    FROM defenses GROUP BY sink_id
), reach AS (
    SELECT sink_id, max(fed) AS reach FROM owned JOIN (SELECT label, count(*) AS fed FROM owned GROUP BY label) USING (label) GROUP BY sink_id
), metrics AS (
    SELECT s.*, coalesce(n, 0) AS n, coalesce(hops, 0) AS hops, coalesce(control, 0) AS control, coalesce(unknown, 0) AS unknown, coalesce(churn, 0) AS churn,
           coalesce(parts, 0) AS parts, coalesce(suppliers, 0) AS suppliers, coalesce(props, 0) AS props,
           coalesce(parts, 0) + coalesce(suppliers, 0) + CASE WHEN has_literal THEN 1 ELSE 0 END AS merge_width,
           coalesce(guards, 0) AS guards, coalesce(impossible, 0) AS impossible, coalesce(loose, 0) AS loose, coalesce(certain, 0) AS certain,
           coalesce(guards, 0) - coalesce(certain, 0) AS actionable, greatest(0, coalesce(guards, 0) - coalesce(certain, 0) - 1) AS repeated,
           coalesce(reach, 1) AS reach
    FROM sinks s LEFT JOIN counted USING (sink_id) LEFT JOIN guards USING (sink_id) LEFT JOIN reach USING (sink_id)
)"""

PACKS = """
packs AS (SELECT DISTINCT sink_id, 'pack.' || part AS pack_key FROM items),
pack_sums AS (
    SELECT pack_key, count(*) AS sink_count, list_sort(list_distinct(list(family))) AS families, sum(guards)::BIGINT AS guards, sum(churn)::BIGINT AS churn,
           sum(hops)::BIGINT AS hops, max(reach) AS max_reach
    FROM packs JOIN metrics USING (sink_id) GROUP BY pack_key HAVING count(*) >= 2
), pack_roots AS (
    SELECT pack_key, count(DISTINCT label) AS roots, count(DISTINCT label) FILTER (WHERE kind = 'prop-read') AS props
    FROM packs JOIN owned USING (sink_id) GROUP BY pack_key
), pack_groups AS (
    SELECT *, CASE verdict WHEN 'relay-bag' THEN 12 WHEN 'overpacked-bag' THEN 9 WHEN 'mirror-object' THEN 7 ELSE 0 END AS risk
    FROM (SELECT p.*, r.roots, r.props,
                 CASE WHEN roots >= 2 AND len(list_filter(families, lambda f: f NOT IN ('geometry', 'svg-shell', 'other'))) = 0 AND props >= 0.75 * roots
                           AND hops <= sink_count AND guards = 0 AND len(families) <= 2 THEN 'mirror-object'
                      WHEN max_reach >= 6 AND len(families) >= 2 AND roots >= 2 THEN 'relay-bag'
                      WHEN len(families) >= 2 THEN 'overpacked-bag' ELSE 'cohesive-render-model' END AS verdict
          FROM pack_sums p JOIN pack_roots r USING (pack_key))
), pack_of AS (
    SELECT sink_id, max(len(families)) AS diversity, max(risk) AS risk, count(*) FILTER (WHERE risk > 0) AS suspicious
    FROM packs JOIN pack_groups USING (pack_key) GROUP BY sink_id
)"""


def _n(x: str) -> str:
    return f"least(1.0::DOUBLE, ln({x} + 1.0::DOUBLE) / ln(21.0::DOUBLE))"


def _sum(terms: list[tuple[float, str]]) -> str:
    return "greatest(0.0::DOUBLE, least(1.0::DOUBLE, " + " + ".join(f"{w}::DOUBLE * {_n(c)}" for w, c in terms) + "))"


SCORED = f"""
based AS (
    SELECT m.*, coalesce(p.diversity, 0) AS diversity, coalesce(p.risk, 0) AS risk, coalesce(p.suspicious, 0) AS suspicious
    FROM metrics m LEFT JOIN pack_of p USING (sink_id)
), measured AS (
    SELECT *, {_sum([(0.15, "n"), (0.13, "hops"), (0.16, "churn"), (0.15, "actionable"), (0.15, "impossible"), (0.1, "control"), (0.08, "repeated"), (0.08, "risk")])} AS burden,
           {_sum([(0.4, "reach"), (0.2, "n"), (0.15, "hops"), (0.15, "merge_width"), (0.1, "2 * n")])} AS centrality,
           {_sum([(0.25, "reach"), (0.25, "unknown"), (0.15, "control"), (0.1, "hops"), (0.25, "2 * n")])} AS change_risk,
           CASE WHEN unknown > 0 THEN 72 WHEN loose > 0 THEN 80 WHEN impossible > 0 THEN 99 ELSE 88 END AS confidence
    FROM based
), tagged AS (
    SELECT *, (confidence / 100.0::DOUBLE) * burden * pow(1.0::DOUBLE - centrality, 0.7::DOUBLE) / (0.25::DOUBLE + change_risk) AS quick_win,
           (confidence / 100.0::DOUBLE) * burden * centrality * greatest(0.1::DOUBLE, centrality) / (0.25::DOUBLE + change_risk) AS central_leverage,
           burden * centrality * least(1.0::DOUBLE, unknown / 3.0::DOUBLE) AS investigation_priority,
           CASE WHEN burden < 0.08 AND actionable + impossible + churn + control + hops + risk + suspicious + unknown + repeated = 0 THEN 'usage' ELSE 'finding' END AS tier,
           (CASE WHEN n <= 1 THEN 'trivial' WHEN n <= 3 THEN 'shallow' WHEN n <= 7 THEN 'medium' ELSE 'deep' END) || ' '
           || CASE WHEN churn > 0 THEN 'object-pack -> ' ELSE '' END || CASE WHEN hops > 0 THEN 'call -> ' ELSE '' END
           || CASE WHEN control > 0 THEN 'conditional -> ' ELSE '' END
           || CASE WHEN impossible > 0 THEN 'impossible-defense -> ' WHEN guards > 0 THEN 'fallback -> ' ELSE '' END
           || 'jsx-sink' || CASE WHEN unknown > 0 THEN ' -> (unknown)' ELSE '' END AS signature,
           (guards > 0 OR (control > 0 AND props > 0)) AS is_domain,
           (merge_width > 1 AND hops = 0 AND parts > 0 AND props = parts AND NOT has_literal) AS is_relay,
           (category = 'render-control' AND (label LIKE 'when=%' OR (control > 0 AND guards > 0))) AS is_gate
    FROM measured
), scored AS (
    SELECT *, CASE WHEN family = 'svg-shell' THEN 'svg-shell' WHEN category = 'style' THEN 'presentation-pack' WHEN is_gate THEN 'control-flow-gate'
                   WHEN family = 'geometry' THEN 'geometry-chain' WHEN label LIKE 'each=%' THEN 'collection-render-model'
                   WHEN family = 'style' AND churn > 0 THEN 'presentation-pack'
                   WHEN is_domain THEN 'domain-normalization' WHEN is_relay THEN 'cross-component-relay' ELSE 'uncategorized' END AS shape,
           CASE WHEN is_relay THEN 'cross-component prop relay' WHEN merge_width >= 3 AND reach >= 4 THEN 'architectural fan-in'
                WHEN reach > 5 THEN 'feature hook extraction' ELSE 'local component cleanup' END AS ownership
    FROM tagged
), ranked AS (
    SELECT * FROM scored WHERE category <> 'event-handler'
       AND NOT (has_literal AND parts = 0 AND n <= 1 AND guards = 0 AND churn = 0 AND control = 0 AND unknown = 0)
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY round(burden, 9) DESC, seq) AS rank FROM ranked
)"""

BASE = f"WITH {SINKS},{ITEMS},{DEFENSES},{ROOTS}"
MEASURED = f"{BASE},{METRICS}"
PACKED = f"{MEASURED},{PACKS}"
ALL = f"{PACKED},{SCORED}"
