"""Ratios with their denominators, null where a layer has an error of the evaluator, a call no test, or there is nothing."""

from loomspark.operators import evaluation as E

SCHEMA = "project string, status string"


def test_summary(spark):
    components = [("a", s) for s in ("COMPILE_PASSED", "COMPILE_PASSED", "NOT_FOUND", "AMBIGUOUS", "COMPILE_FAILED")] + [("b", "EVALUATOR_ERROR"), ("b", "COMPILE_PASSED")]
    pages = [("a", "PAGE_COMPILE_PASSED"), ("a", "PAGE_MISSING"), ("b", "EVALUATOR_ERROR"), ("c", "PAGE_AMBIGUOUS")]
    calls = [("a", "TEST_PASSED"), ("a", "TEST_FAILED"), ("a", "PAGE_UNAVAILABLE"), ("b", "TEST_NOT_CONFIGURED"), ("c", "EVALUATOR_ERROR"), ("c", "TEST_PASSED"), (None, "TEST_PASSED")]
    got = {r["project"]: r for r in E.summary(*(spark.createDataFrame(x, SCHEMA) for x in (components, pages, calls)), "project").collect()}
    ratios = {p: tuple(r[c] for c in ("c_cpr", "c_mr", "c_cfr", "p_cpr", "call_test_coverage", "pectpr")) for p, r in got.items()}
    assert ratios == {"a": (0.4, 0.4, 0.2, 0.5, 1.0, 1 / 3), "b": (None, None, None, None, 0.0, None), "c": (None, None, None, 0.0, 1.0, None), None: (None, None, None, None, 1.0, 1.0)}
    assert (got["a"]["component_total"], got["a"]["component_missing"], got["c"]["page_missing"], got["b"]["call_not_configured"]) == (5, 2, 1, 1)
    none = spark.createDataFrame([], SCHEMA)
    assert E.summary(none, none, none, "project").collect() == []
