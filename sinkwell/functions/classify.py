"""Classifications as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute names by family.  Fixed values.
SVG_SHELL = ("width", "height", "viewBox", "viewbox")
GEOMETRY = ("transform", "x", "y", "cx", "cy", "d", "points", "r", "dx", "dy", "x1", "y1", "x2", "y2", "rx", "ry")
STYLE = ("class", "className", "style")
CONTROL_FLOW = ("when", "each", "fallback")
IDENTITY = ("id", "href", "xlink:href", "for", "name", "headers")
PACK_RISK = {"relay-bag": 12, "overpacked-bag": 9, "mirror-object": 7, "cohesive-render-model": 0, "normalization-boundary": 0}
FIRST_CUT = {
    "svg-shell": "keep shell sizing inline",
    "local-scalar-geometry": "name repeated local scalars",
    "geometry-chain": "extract render item geometry",
    "collection-render-model": "extract rendered items",
    "control-flow-gate": "name the predicate",
    "presentation-pack": "split the class/style object",
    "domain-normalization": "normalize at the boundary",
    "solid-prop-default-boundary": "promote prop defaults to mergeProps",
    "cross-component-relay": "move state behind context",
}
CERTAINTY = "(?i)parser-boundary|compatibility|optional|solid prop default|api-choice"


def queue(unknown_edges: Column, unknown_verdict: Column, reach: Column, depth: Column, threshold) -> Column:
    return (
        F.when((unknown_edges > 0) | unknown_verdict, "investigation")
        .when((reach >= threshold) | (depth > 10), "central-leverage")
        .otherwise("peripheral-quick-win")
    )


SIGNALS = (
    "actionable_defensive_operation_count",
    "impossible_defense_count",
    "representation_churn",
    "control_dependency_count",
    "helper_hops",
    "pack_risk",
    "suspicious_pack_count",
    "unknown_edge_count",
    "repeated_normalization",
)


def tier() -> Column:
    return F.when((F.col("burden") < 0.08) & (F.greatest(*SIGNALS) <= 0), "usage").otherwise("finding")


def confidence(unknown_edges: Column, unknown_verdict: Column, impossible: Column) -> Column:
    return F.when(unknown_edges > 0, 72).when(unknown_verdict, 80).when(impossible > 0, 99).otherwise(88)


def depth_band(depth: Column) -> Column:
    return F.when(depth <= 1, "trivial").when(depth <= 3, "shallow").when(depth <= 7, "medium").otherwise("deep")


def signature() -> Column:
    parts = F.concat_ws(
        " -> ",
        F.when(F.col("representation_churn") > 0, "object-pack"),
        F.when(F.col("helper_hops") > 0, "call"),
        F.when(F.col("control_dependency_count") > 0, "conditional"),
        F.when(F.col("impossible_defense_count") > 0, "impossible-defense").when(F.col("defensive_operation_count") > 0, "fallback"),
        F.lit("jsx-sink"),
        F.when(F.col("unknown_edge_count") > 0, "(unknown)"),
    )
    return F.concat_ws(" ", depth_band(F.col("maximum_path_depth")), parts)


def attribute(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"^([A-Za-z0-9_-]+)=\{", 1), F.lit(""))


def family(attr: Column, category: Column) -> Column:
    return (
        F.when(attr.isin(*SVG_SHELL), "svg-shell")
        .when(attr.isin(*GEOMETRY), "geometry")
        .when(attr.isin(*CONTROL_FLOW), "control-flow")
        .when(attr.isin(*STYLE), "style")
        .when(attr.isin(*IDENTITY), "identity")
        .when(category == "rendered-value", "text")
        .otherwise("other")
    )


#: Attributes of local scalar geometry, and what rules it out.  Fixed values.
SCALAR_GEOMETRY = ("cx", "cy", "r", "stroke-dasharray", "strokeDasharray", "stroke-dashoffset", "strokeDashoffset")
SCALAR_MATH = r"[-+*/%]|(?i)\b(?:Math\.|PI|circumference|radius|center|dash|size|strokeWidth|stroke-width)\b"
NOT_SCALAR = r"\b(?:map|filter|flatMap|reduce|For|each|index\s*\(|value\s*=>)\b"


def shapes(attr: Column, category: Column, prop_roots: Column, all_relay: Column, step_text: Column | None = None, path_text: Column | None = None, has_template: Column | None = None, origins: Column | None = None, cohesive: Column | None = None) -> Column:
    """Shape tags in priority order, from the metric columns and facts about the roots.

    ``step_text`` holds the labels of the steps, ``path_text`` the sink's own label and expression besides, ``origins`` those of the
    guards; ``cohesive`` tells of a cohesive render model among the packs.  What is not given is absent.
    """
    no, text = F.lit(False), F.lit("") if step_text is None else F.coalesce(step_text, F.lit(""))
    path = text if path_text is None else F.coalesce(path_text, F.lit(""))
    template = no if has_template is None else has_template
    defaults = no if origins is None else F.exists(origins, lambda o: o.rlike("(?i)solid prop default"))
    scalar = attr.isin(*SCALAR_GEOMETRY) & ~(no if cohesive is None else cohesive) & ~path.rlike(NOT_SCALAR) & (F.col("pack_risk") <= 0) & path.rlike(SCALAR_MATH)
    control, guards = F.col("control_dependency_count"), F.col("defensive_operation_count")
    return F.array_compact(
        F.array(
            F.when(attr.isin(*SVG_SHELL), "svg-shell"),
            F.when(scalar, "local-scalar-geometry"),
            F.when(attr.isin(*GEOMETRY) | (template & (control > 0)), "geometry-chain"),
            F.when(((category == "render-control") & (attr == "each")) | text.rlike(r"\.(map|filter|sort|flatMap|reduce|slice)\("), "collection-render-model"),
            F.when(attr.isin("when", "fallback") | ((control > 0) & (guards > 0) & (category == "render-control")), "control-flow-gate"),
            F.when((category == "style") | ((F.col("representation_churn") > 0) & attr.isin(*STYLE)), "presentation-pack"),
            F.when((guards > 0) | ((control > 0) & prop_roots), "domain-normalization"),
            F.when(defaults, "solid-prop-default-boundary"),
            F.when((F.col("merge_width") > 1) & (F.col("helper_hops") == 0) & all_relay, "cross-component-relay"),
        )
    )


def primary_shape(tags: Column, fam: Column, category: Column) -> Column:
    return (
        F.when((fam == "svg-shell") & F.array_contains(tags, "svg-shell"), "svg-shell")
        .when((category == "style") & F.array_contains(tags, "presentation-pack"), "presentation-pack")
        .when((category == "render-control") & F.array_contains(tags, "control-flow-gate"), "control-flow-gate")
        .when(F.array_contains(tags, "solid-prop-default-boundary") & ((F.try_element_at(tags, F.lit(1)) == "domain-normalization") | (F.size(tags) == 1)), "solid-prop-default-boundary")
        .otherwise(F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit("uncategorized")))
    )


def ownership(tags: Column, merge_width: Column, reach: Column) -> Column:
    return (
        F.when(F.array_contains(tags, "cross-component-relay"), "cross-component prop relay")
        .when((merge_width >= 3) & (reach >= 4), "architectural fan-in")
        .when(reach > 5, "feature hook extraction")
        .otherwise("local component cleanup")
    )


def first_cut(shape: Column) -> Column:
    out = F
    for k, v in FIRST_CUT.items():
        out = out.when(shape == k, v)
    return out.otherwise("local boundary cleanup")


def pack_verdict(parser: Column, guards: Column, hops: Column, mirror: Column, relay: Column, families: Column) -> Column:
    return (
        F.when(parser & ((guards > 0) | (hops > 0)), "normalization-boundary")
        .when(mirror, "mirror-object")
        .when(relay, "relay-bag")
        .when(families >= 2, "overpacked-bag")
        .otherwise("cohesive-render-model")
    )


def pack_risk(verdict: Column) -> Column:
    out = F
    for k, v in PACK_RISK.items():
        out = out.when(verdict == k, v)
    return out.otherwise(4)


def report_severity(impossible: Column, burden: Column) -> Column:
    return F.when(impossible > 0, "HIGH").when(burden > 0.55, "MEDIUM").otherwise("LOW")


def page_severity(burden: Column) -> Column:
    return F.when(burden >= 0.66, "high").when(burden >= 0.33, "medium").otherwise("low")


def boundary_verdict(pass_through, depth, scalar, in_sources, callers, type_leak, churn, guards, impossible) -> Column:
    messy = (depth >= 6) | (churn >= 4) | (guards >= 3) | (impossible > 0)
    return (
        F.when(pass_through & (depth <= 1), "thin pass-through (inline)")
        .when(scalar, "local scalar math")
        .when((in_sources >= 3) & (callers >= 2), "confluence / junction")
        .when(type_leak, "leaky boundary")
        .when(messy, "messy internals")
        .otherwise("clean pipe")
    )


def type_leak(type_text: Column) -> Column:
    return F.coalesce(type_text.rlike(r"\b(any|unknown)\b") | (F.size(F.split(type_text, r"\|")) > 4), F.lit(False))


#: Step kinds of a scalar helper, and names that mark a layout helper or a scalar read.  Fixed values.
SCALAR_KINDS = ("call", "alias", "property-read", "operation", "literal", "conditional", "source", "parameter")
LAYOUT = r"^(compute|build|create|derive)[A-Z].*(Layout|Geometry|Bounds|Scale|Chart)"
LAYOUT_FIELD = r"(?i)^(inner|outer|width|height|left|right|top|bottom|x|y|scale|padding|domain|range)"
SCALAR_NAME = r"(?i)^(has|show|is|axis|tick|title|label|inner|outer|start|end|x|y|width|height|left|right|top|bottom)"


def background(steps: Column, metrics) -> Column:
    """CLS-3: penalty of a background finding, else null.  ``steps`` is an array of (kind, label) in order; ``metrics`` names columns."""
    clean = (metrics("impossible_defense_count") == 0) & (metrics("defensive_operation_count") == 0) & (metrics("unknown_edge_count") == 0)
    helper = F.try_element_at(F.filter(steps, lambda s: (s["kind"] == "call") & s["label"].rlike(LAYOUT)), F.lit(1))
    field = F.try_element_at(F.filter(steps, lambda s: s["kind"] == "property-read"), F.lit(-1))["label"]
    healthy = clean & helper.isNotNull() & F.coalesce(field.rlike(LAYOUT_FIELD), F.lit(False))
    text = F.array_join(F.transform(steps, lambda s: s["label"]), " ")
    final = F.try_element_at(F.filter(steps, lambda s: s["kind"].isin("call", "alias", "property-read")), F.lit(-1))
    name = F.regexp_replace(final["label"], r"\(\)$", "")
    scalar = (
        clean
        & (metrics("maximum_path_depth") <= 7)
        & (metrics("representation_churn") == 0)
        & (metrics("pack_risk") == 0)
        & (metrics("merge_width") <= 3)
        & F.forall(steps, lambda s: s["kind"].isin(*SCALAR_KINDS))
        & text.rlike(r"[-+*/%<>!]|\b(Math|max|min|round|floor|ceil)\b")
        & F.coalesce(final["kind"].isin("call", "alias") & name.rlike(SCALAR_NAME), F.lit(False))
    )
    return F.when(healthy, 0.25).when(scalar, 0.35)
