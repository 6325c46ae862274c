"""Evaluation: statuses, fixed-denominator ratios, rates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.ratios import safe_ratio
from loomspark.operators import evaluation as E
from loomspark.queries.base import Query, shared_sql
from loomspark.sources.tables import table


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality").isNull(), "NOT_FOUND").when(F.col("toxic") == 1, "EVALUATOR_ERROR").when(F.col("quality") == 1, "PASSED").otherwise("FAILED")
    rows = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left").select("lang", "source", status.alias("status"))
    total = F.count("*")
    count = lambda s: F.count_if(F.col("status") == s)
    valid = count("EVALUATOR_ERROR") == 0
    return rows.groupBy("lang", "source").agg(
        total.alias("total"),
        count("PASSED").alias("passed"),
        count("FAILED").alias("failed"),
        count("NOT_FOUND").alias("not_found"),
        count("EVALUATOR_ERROR").alias("errors"),
        F.round(safe_ratio(count("PASSED"), total, valid), 6).alias("pass_ratio"),
        F.round(safe_ratio(count("NOT_FOUND"), total, valid), 6).alias("missing_ratio"),
        F.round(safe_ratio(count("FAILED"), total, valid), 6).alias("fail_ratio"),
    )


EVAL_SUMMARY = """
WITH s AS (
  SELECT lang, source,
         CASE WHEN quality IS NULL THEN 'NOT_FOUND' WHEN toxic = 1 THEN 'EVALUATOR_ERROR'
              WHEN quality = 1 THEN 'PASSED' ELSE 'FAILED' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)),
c AS (
  SELECT lang, source, count(*) AS total, count_if(status = 'PASSED') AS passed, count_if(status = 'FAILED') AS failed,
         count_if(status = 'NOT_FOUND') AS not_found, count_if(status = 'EVALUATOR_ERROR') AS errors
  FROM s GROUP BY ALL)
SELECT lang, source, total, passed::BIGINT AS passed, failed::BIGINT AS failed, not_found::BIGINT AS not_found, errors::BIGINT AS errors,
       CASE WHEN errors = 0 THEN round(passed / total, 6) END AS pass_ratio,
       CASE WHEN errors = 0 THEN round(not_found / total, 6) END AS missing_ratio,
       CASE WHEN errors = 0 THEN round(failed / total, 6) END AS fail_ratio
FROM c
"""

QUERIES = {"eval_summary": Query(eval_summary, EVAL_SUMMARY)}

CALL_STATUS = """
WITH s AS (
  SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'ERROR' WHEN o_orderstatus = 'F' THEN 'PASSED' ELSE 'FAILED' END AS source_status,
         CASE WHEN c_custkey IS NULL OR n_nationkey IS NULL THEN 'NOT_FOUND' WHEN c_acctbal < 0 THEN 'ERROR' WHEN c_acctbal < 5000 THEN 'FAILED' ELSE 'PASSED' END AS target_status
  FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {nation} ON c_nationkey = n_nationkey)
SELECT CASE WHEN source_status = 'ERROR' OR target_status = 'ERROR' THEN 'EVALUATOR_ERROR'
            WHEN source_status = 'PASSED' AND target_status = 'PASSED' THEN 'TESTABLE' ELSE 'UNAVAILABLE' END AS call_status,
       source_status, target_status, count(*) AS n
FROM s GROUP BY 1, 2, 3
"""

#: Handled is clamped to the total per component, micro rates are per parser, the macro rate is their mean.
RATES = """
WITH c AS (
  SELECT lang, source, count(quality) AS handled, count(*) - 1 AS total FROM {documents} LEFT JOIN {labels} USING (doc_id) GROUP BY lang, source),
p AS (
  SELECT lang, sum(least(total, greatest(0, handled))) AS handled, sum(total) AS total FROM c GROUP BY lang),
r AS (
  SELECT lang, CAST(handled AS BIGINT) AS handled, CAST(total AS BIGINT) AS total, CASE WHEN total = 0 THEN 1.0E0 ELSE CAST(handled AS DOUBLE) / CAST(total AS DOUBLE) END AS rate FROM p)
SELECT lang, handled, total, round(rate, 6) AS rate, rate + 1E-12 >= 0.4E0 AS passed,
       round(avg(rate) OVER (), 6) AS macro_rate,
       avg(rate) OVER () + 1E-12 >= 0.4E0 AND min(rate) OVER () + 1E-12 >= 0.4E0 AS all_passed
FROM r
"""

SCORES = """
WITH s AS (
  SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber % 5 = 0 THEN 'INVALID' ELSE 'EVALUATED' END AS status,
         l_quantity * 2 AS component, 100 - l_discount * 100 AS layout, 100 - l_tax * 100 AS style, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS content
  FROM {lineitem}),
v AS (
  SELECT *, CASE WHEN status = 'EVALUATED' THEN 0.35E0 * component + 0.30E0 * layout + 0.20E0 * style + 0.15E0 * content END AS overall FROM s)
SELECT l_returnflag, l_linestatus, count(*) AS pairs, sum(CASE WHEN status = 'EVALUATED' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS coverage,
       round(avg(CASE WHEN status = 'EVALUATED' THEN component END), 4) AS mean_component, round(avg(CASE WHEN status = 'EVALUATED' THEN layout END), 4) AS mean_layout,
       round(avg(CASE WHEN status = 'EVALUATED' THEN style END), 4) AS mean_style, round(avg(overall), 4) AS mean_overall
FROM v GROUP BY l_returnflag, l_linestatus
"""

STATS = """
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS total,
       round(coalesce(min(c_acctbal), 0), 2) AS least, round(coalesce(median(c_acctbal), 0), 4) AS middle, round(coalesce(max(c_acctbal), 0), 2) AS most,
       count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS building,
       round(CAST(count(CASE WHEN c_acctbal < 0 THEN 1 END) AS DOUBLE) / CASE WHEN count(c_custkey) = 0 THEN 1 ELSE count(c_custkey) END, 6) AS negative_share
FROM {region} LEFT JOIN {nation} ON r_regionkey = n_regionkey LEFT JOIN {customer} ON n_nationkey = c_nationkey
GROUP BY r_name
"""


def counter_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two sources merged by key; the gap counts what the second lacks of the first."""
    props = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    raw = props.groupBy(F.pmod(F.col("k"), F.lit(50)).alias("key")).agg(F.count("*").alias("raw"), F.sum("k").alias("raw_sum"))
    ir = table(spark, sf_dir, "orders").groupBy(F.pmod(F.col("o_custkey"), F.lit(60)).alias("key")).agg(F.count("*").alias("ir"))
    zero = F.lit(0).cast("long")
    return raw.join(ir, "key", "full").select("key", F.coalesce("raw", zero).alias("raw"), F.coalesce("ir", zero).alias("ir"), F.coalesce("raw_sum", zero).alias("raw_sum"), F.greatest(zero, F.coalesce("raw", zero) - F.coalesce("ir", zero)).alias("gap"))


GAP = """
WITH raw AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 50 AS key, count(*) AS raw, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS raw_sum FROM events GROUP BY 1),
ir AS (SELECT o_custkey % 60 AS key, count(*) AS ir FROM orders GROUP BY 1)
SELECT key, coalesce(raw, 0) AS raw, coalesce(ir, 0) AS ir, coalesce(raw_sum, 0) AS raw_sum, greatest(0, coalesce(raw, 0) - coalesce(ir, 0)) AS gap
FROM raw FULL JOIN ir USING (key)
"""

USAGE = """
SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS conversations,
       count(*) > 0 AND min(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) = 1 AS all_ok
FROM {conversations} GROUP BY role
"""

INVENTORY = """
WITH f AS (
  SELECT page_id, split_part(split_part(url, '/', 3), '.', -1) AS tld, length(html) AS size, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%/' THEN 'directory' ELSE 'plain' END AS kind FROM {pages})
SELECT tld, kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, count(doc_id) AS present, count(*) - count(doc_id) AS missing, count(*) = count(doc_id) AS complete
FROM f LEFT JOIN {documents} ON page_id = doc_id GROUP BY tld, kind
"""

#: Rates of every level in one plan: micro by sums, macro by means of the level below. A window over a project holds its
#: parsers' rows and its own; of all projects it holds the parsers' totals, whose mean is the macro rate over parsers.
ROLLUP = """
WITH c AS (
  SELECT source AS project, lang AS parser, n_chars % 5 AS component, count(quality) AS handled, count(*) - 1 AS total FROM {documents} LEFT JOIN {labels} USING (doc_id) GROUP BY source, lang, n_chars % 5),
k AS (SELECT project, parser, least(total, greatest(0, handled)) AS handled, total FROM c),
g AS (
  SELECT project, parser, CAST(grouping(project) AS BIGINT) AS all_projects, CAST(grouping(parser) AS BIGINT) AS all_parsers, CAST(sum(handled) AS BIGINT) AS handled, CAST(sum(total) AS BIGINT) AS total, count(*) AS components
  FROM k GROUP BY GROUPING SETS ((project, parser), (project), (parser), ())),
r AS (SELECT *, CASE WHEN total = 0 THEN 1.0E0 ELSE CAST(handled AS DOUBLE) / CAST(total AS DOUBLE) END AS rate FROM g),
w AS (
  SELECT *, avg(CASE WHEN all_parsers = 0 THEN rate END) OVER (PARTITION BY all_projects, project) AS over_parsers, min(CASE WHEN all_parsers = 0 THEN rate END) OVER (PARTITION BY all_projects, project) AS least_parser,
         avg(CASE WHEN all_projects = 0 THEN rate END) OVER (PARTITION BY all_parsers, parser) AS over_projects, min(CASE WHEN all_projects = 0 THEN rate END) OVER (PARTITION BY all_parsers, parser) AS least_project FROM r)
SELECT project, parser, all_projects, all_parsers, components, handled, total, round(rate, 6) AS micro, rate + 1E-12 >= 0.4E0 AS passed,
       CASE WHEN all_parsers = 1 THEN round(over_parsers, 6) END AS macro_parsers, CASE WHEN all_parsers = 1 THEN over_parsers + 1E-12 >= 0.4E0 AND least_parser + 1E-12 >= 0.4E0 END AS parsers_passed,
       CASE WHEN all_projects = 1 THEN round(over_projects, 6) END AS macro_projects, CASE WHEN all_projects = 1 THEN over_projects + 1E-12 >= 0.4E0 AND least_project + 1E-12 >= 0.4E0 END AS projects_passed
FROM w
"""

QUERIES |= {
    "rate_rollup": shared_sql(ROLLUP),
    "call_status_precedence": shared_sql(CALL_STATUS),
    "rate_micro_macro": shared_sql(RATES),
    "weighted_score_summary": shared_sql(SCORES),
    "dataset_stats": shared_sql(STATS),
    "counter_merge_gap": Query(counter_merge_gap, GAP),
    "usage_totals": shared_sql(USAGE),
    "inventory_summary": shared_sql(INVENTORY),
}


def evaluation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six ratios of each nation: its customers' order lines as components, their orders as pages, and the suppliers'
    lines as calls. Some nations have errors in one layer, some calls without a test."""
    t = lambda name: table(spark, sf_dir, name)
    when = lambda pairs, other: F.coalesce(*(F.when(F.expr(test), status) for test, status in pairs), F.lit(other))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_acctbal")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    component = when([("c_nationkey % 6 = 0 and l_linenumber = 7", "EVALUATOR_ERROR"), ("l_discount < 0.01", "NOT_FOUND"), ("l_discount < 0.02", "AMBIGUOUS"), ("l_quantity < 20", "COMPILE_FAILED")], "COMPILE_PASSED")
    page = when([("c_nationkey % 5 = 0 and c_acctbal < 0", "EVALUATOR_ERROR"), ("o_orderpriority like '5%'", "PAGE_MISSING"), ("o_orderpriority like '4%'", "PAGE_AMBIGUOUS"), ("o_orderstatus = 'F'", "PAGE_COMPILE_FAILED")], "PAGE_COMPILE_PASSED")
    call = when([("s_nationkey % 7 = 0 and l_linenumber = 1 and l_quantity > 40", "EVALUATOR_ERROR"), ("s_nationkey % 4 = 0 and l_linenumber = 2", "TEST_NOT_CONFIGURED"), ("l_discount > 0.09", "PAGE_UNAVAILABLE"), ("l_quantity < 10", "TEST_FAILED")], "TEST_PASSED")
    components = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").cast("long").alias("project"), component.alias("status"))
    calls = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("long").alias("project"), call.alias("status"))
    return E.summary(components, orders.select(F.col("c_nationkey").cast("long").alias("project"), page.alias("status")), calls, "project")


def _count_sql(layer: str, *statuses: str) -> str:
    return f"count(*) FILTER (layer = '{layer}'" + (f" AND status IN ({', '.join(repr(s) for s in statuses)})" if statuses else "") + ")"


_COUNTS_SQL = ", ".join([f"{_count_sql(layer)} AS {layer}_total" for layer in E.COUNTS] + [f"{_count_sql(layer, *of)} AS {layer}_{name}" for layer, names in E.COUNTS.items() for name, of in names.items()])
RATIOS = f"""
WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (
  SELECT CAST(c_nationkey AS BIGINT) AS project, 'component' AS layer, CASE WHEN c_nationkey % 6 = 0 AND l_linenumber = 7 THEN 'EVALUATOR_ERROR' WHEN l_discount < 0.01 THEN 'NOT_FOUND' WHEN l_discount < 0.02 THEN 'AMBIGUOUS' WHEN l_quantity < 20 THEN 'COMPILE_FAILED' ELSE 'COMPILE_PASSED' END AS status FROM lineitem JOIN o ON l_orderkey = o_orderkey
  UNION ALL SELECT c_nationkey, 'page', CASE WHEN c_nationkey % 5 = 0 AND c_acctbal < 0 THEN 'EVALUATOR_ERROR' WHEN o_orderpriority LIKE '5%' THEN 'PAGE_MISSING' WHEN o_orderpriority LIKE '4%' THEN 'PAGE_AMBIGUOUS' WHEN o_orderstatus = 'F' THEN 'PAGE_COMPILE_FAILED' ELSE 'PAGE_COMPILE_PASSED' END FROM o
  UNION ALL SELECT s_nationkey, 'call', CASE WHEN s_nationkey % 7 = 0 AND l_linenumber = 1 AND l_quantity > 40 THEN 'EVALUATOR_ERROR' WHEN s_nationkey % 4 = 0 AND l_linenumber = 2 THEN 'TEST_NOT_CONFIGURED' WHEN l_discount > 0.09 THEN 'PAGE_UNAVAILABLE' WHEN l_quantity < 10 THEN 'TEST_FAILED' ELSE 'TEST_PASSED' END FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT project, {_COUNTS_SQL} FROM r GROUP BY project)
SELECT *, CASE WHEN component_errors = 0 THEN component_passed / nullif(component_total, 0) END AS c_cpr, CASE WHEN component_errors = 0 THEN component_missing / nullif(component_total, 0) END AS c_mr,
       CASE WHEN component_errors = 0 THEN component_failed / nullif(component_total, 0) END AS c_cfr, CASE WHEN page_errors = 0 THEN page_passed / nullif(page_total, 0) END AS p_cpr,
       (call_total - call_not_configured) / nullif(call_total, 0) AS call_test_coverage, CASE WHEN call_errors = 0 AND call_not_configured = 0 THEN call_passed / nullif(call_total, 0) END AS pectpr FROM c
"""

QUERIES |= {"evaluation_ratios": Query(evaluation_ratios, RATIOS)}
