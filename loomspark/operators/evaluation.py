"""Summaries of evaluated components, pages and calls, with ratios that an error of the evaluator makes null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ratios import safe_ratio

ERROR = "EVALUATOR_ERROR"
#: Layer: its count's name and the statuses that it counts.
COUNTS = {
    "component": {"passed": ("COMPILE_PASSED",), "missing": ("NOT_FOUND", "AMBIGUOUS"), "failed": ("COMPILE_FAILED",), "errors": (ERROR,)},
    "page": {"passed": ("PAGE_COMPILE_PASSED",), "missing": ("PAGE_MISSING", "PAGE_AMBIGUOUS"), "failed": ("PAGE_COMPILE_FAILED",), "errors": (ERROR,)},
    "call": {"passed": ("TEST_PASSED",), "failed": ("TEST_FAILED",), "unavailable": ("PAGE_UNAVAILABLE",), "not_configured": ("TEST_NOT_CONFIGURED",), "errors": (ERROR,)},
}


def summary(components: DataFrame, pages: DataFrame, calls: DataFrame, by: str) -> DataFrame:
    """Three tables (by, status) -> a row for each value of by in any of them: totals and counts of each layer, and c_cpr,
    c_mr, c_cfr, p_cpr, call_test_coverage and pectpr.

    Denominators are all results of a layer. A ratio is null if there are none, or if the layer has an error of the
    evaluator; pectpr also if a call has no test, the coverage never for that. One aggregate, summed before it shuffles."""
    every = None
    for layer, rows in (("component", components), ("page", pages), ("call", calls)):
        part = rows.select(by, F.lit(layer).alias("layer"), "status")
        every = part if every is None else every.unionByName(part)
    n = lambda layer, *statuses: F.count_if((F.col("layer") == layer) & (F.col("status").isin(*statuses) if statuses else F.lit(True)))
    counts = [n(layer).alias(f"{layer}_total") for layer in COUNTS] + [n(layer, *of).alias(f"{layer}_{name}") for layer, names in COUNTS.items() for name, of in names.items()]
    held = every.groupBy(by).agg(*counts)
    c = F.col
    sound = {layer: c(f"{layer}_errors") == 0 for layer in COUNTS}
    return held.select(
        "*",
        safe_ratio(c("component_passed"), c("component_total"), sound["component"]).alias("c_cpr"),
        safe_ratio(c("component_missing"), c("component_total"), sound["component"]).alias("c_mr"),
        safe_ratio(c("component_failed"), c("component_total"), sound["component"]).alias("c_cfr"),
        safe_ratio(c("page_passed"), c("page_total"), sound["page"]).alias("p_cpr"),
        safe_ratio(c("call_total") - c("call_not_configured"), c("call_total")).alias("call_test_coverage"),
        safe_ratio(c("call_passed"), c("call_total"), sound["call"] & (c("call_not_configured") == 0)).alias("pectpr"),
    )
