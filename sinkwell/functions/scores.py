"""Scores as column expressions over the metric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the burden terms.  Fixed values.
BURDEN = {
    "maximum_path_depth": 0.15,
    "helper_hops": 0.13,
    "representation_churn": 0.16,
    "actionable_defensive_operation_count": 0.15,
    "impossible_defense_count": 0.15,
    "control_dependency_count": 0.1,
    "repeated_normalization": 0.08,
    "pack_risk": 0.08,
}
CENTRALITY = {"reachable_sinks": 0.4, "maximum_path_depth": 0.2, "helper_hops": 0.15, "merge_width": 0.15, "slice_size": 0.1}
CHANGE_RISK = {"reachable_sinks": 0.25, "unknown_edge_count": 0.25, "control_dependency_count": 0.15, "helper_hops": 0.1, "slice_size": 0.25}


def normalized(x: Column) -> Column:
    return F.least(F.lit(1.0), F.log(x + F.lit(1.0)) / F.log(F.lit(21.0)))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(terms: dict[str, float]) -> Column:
    return clamp01(reduce(lambda a, b: a + b, [F.lit(w) * normalized(F.col(c)) for c, w in terms.items()]))


def burden() -> Column:
    return weighted(BURDEN)


def centrality() -> Column:
    return weighted(CENTRALITY)


def change_risk() -> Column:
    return weighted(CHANGE_RISK)


def quick_win(confidence: Column, b: Column, c: Column, r: Column) -> Column:
    return confidence * b * F.pow(F.lit(1.0) - c, F.lit(0.7)) / (F.lit(0.25) + r)


def central_leverage(confidence: Column, b: Column, c: Column, r: Column) -> Column:
    return confidence * b * c * F.greatest(F.lit(0.1), c) / (F.lit(0.25) + r)


def investigation(b: Column, c: Column, unknown: Column) -> Column:
    return b * c * F.least(F.lit(1.0), unknown / F.lit(3.0))


def breakdown() -> Column:
    """The burden terms, largest contribution first; ties keep the order of the terms."""
    terms = [
        F.struct(
            F.lit(c).alias("key"),
            F.lit(w).alias("weight"),
            F.col(c).cast("double").alias("raw"),
            (F.lit(w) * normalized(F.col(c))).alias("contribution"),
            F.lit(i).alias("at"),
        )
        for i, (c, w) in enumerate(BURDEN.items())
    ]

    def order(a: Column, b: Column) -> Column:
        return F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).otherwise(a["at"] - b["at"])

    return F.array_sort(F.array(*terms), order)


def boundary_debt(in_sources, churn, defenses, impossible, depth, type_leak, callers, scalar) -> Column:
    junction = (in_sources >= 3) & (callers >= 2)
    return (
        in_sources
        + churn
        + defenses * 2
        + impossible * 3
        + depth * F.lit(0.5)
        + F.when(type_leak, 4).otherwise(0)
        + F.when(junction, callers * 2).otherwise(0)
        + F.when(scalar, -3).otherwise(0)
    )


def fork_severity(named: Column, sites: Column, exclusive: Column, switches: Column) -> Column:
    return named * 5 + sites + exclusive * 3 + switches * 2


def relay_score(shared: Column, props: Column) -> Column:
    return shared * 3 + props
