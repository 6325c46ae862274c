"""Record contracts: checks that return their violations, and closed-set relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.queries.base import Query, shared_sql
from loomspark.sources.tables import table

FK = """
SELECT 'label_without_document' AS violation, CAST(doc_id AS STRING) AS id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'document_without_label', CAST(doc_id AS STRING) FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'lineitem_without_order', CAST(l_orderkey AS STRING) FROM {lineitem} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'order_without_customer', CAST(o_orderkey AS STRING) FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = o_custkey)
"""

DUPLICATES = """
SELECT 'documents.text' AS key, n AS copies, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT text, count(*) AS n FROM {documents} GROUP BY text HAVING count(*) > 1) a GROUP BY n
UNION ALL
SELECT 'lineitem.order_line', n, count(*), CAST(sum(n - 1) AS BIGINT) FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) b GROUP BY n
"""

PARTIAL = """
SELECT min(doc_id) AS first_doc, count(*) AS copies, count(DISTINCT source) AS sources, min(source) AS first_source, max(source) AS last_source
FROM {documents} GROUP BY text HAVING count(DISTINCT source) > 1
"""

SETS = """
WITH d AS (SELECT DISTINCT lang FROM {documents}), a AS (SELECT DISTINCT d.doc_id FROM {documents} d), b AS (SELECT DISTINCT doc_id FROM {labels}), c AS (SELECT DISTINCT item_id AS doc_id FROM {benchmark})
SELECT 'documents_minus_labels' AS relation, count(*) AS n FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) x
UNION ALL SELECT 'labels_minus_documents', count(*) FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a) x
UNION ALL SELECT 'labels_and_benchmark', count(*) FROM (SELECT doc_id FROM b INTERSECT SELECT doc_id FROM c) x
UNION ALL SELECT 'symmetric_difference', count(*) FROM ((SELECT doc_id FROM a EXCEPT SELECT doc_id FROM c) UNION ALL (SELECT doc_id FROM c EXCEPT SELECT doc_id FROM a)) x
UNION ALL SELECT 'languages', count(*) FROM d
"""


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a list of rules: a row a broken rule, with its severity and each text's worst one."""
    rules = [("empty_line", 1, r"\n[ \t]*\n"), ("shouting", 2, r"[A-Z]{4,}!!"), ("markup", 3, r"[#*$%&]{3}"), ("table", 1, r" \| "), ("secret", 3, r"(?i)(password|token)\s*="), ("license", 1, r"Licensed under")]
    text = F.col("text")
    hits = F.array(*(F.when(text.rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules), F.when(F.length(text) < 20, F.struct(F.lit("too_short").alias("rule"), F.lit(2).alias("severity"))))
    found = table(spark, sf_dir, "documents").select("doc_id", F.filter(hits, lambda x: x.isNotNull()).alias("hits"))
    return found.select("doc_id", F.explode("hits").alias("h"), F.array_max(F.transform("hits", lambda x: x["severity"])).alias("worst")).select("doc_id", "h.rule", "h.severity", "worst")


RULES = r"""
WITH h AS (
  SELECT doc_id, unnest([
    CASE WHEN regexp_matches(text, '\n[ \t]*\n') THEN {'rule': 'empty_line', 'severity': 1} END, CASE WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN {'rule': 'shouting', 'severity': 2} END,
    CASE WHEN regexp_matches(text, '[#*$%&]{3}') THEN {'rule': 'markup', 'severity': 3} END, CASE WHEN regexp_matches(text, ' \| ') THEN {'rule': 'table', 'severity': 1} END,
    CASE WHEN regexp_matches(text, '(?i)(password|token)\s*=') THEN {'rule': 'secret', 'severity': 3} END, CASE WHEN regexp_matches(text, 'Licensed under') THEN {'rule': 'license', 'severity': 1} END,
    CASE WHEN length(text) < 20 THEN {'rule': 'too_short', 'severity': 2} END]) AS h
  FROM documents)
SELECT doc_id, h.rule AS rule, h.severity AS severity, max(h.severity) OVER (PARTITION BY doc_id) AS worst FROM h WHERE h IS NOT NULL
"""


def schema_subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects against a schema: {"k": integer, required, nothing else}."""
    props = F.try_parse_json("props")
    kind = F.schema_of_variant(props)
    k = F.try_variant_get(props, "$.k", "long")
    verdict = F.when(props.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_object").when(k.isNull(), "k_missing_or_not_integer").when(kind != "OBJECT<k: BIGINT>", "additional_properties").otherwise("valid")
    return table(spark, sf_dir, "events").groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min(k).alias("least_k"), F.max(k).alias("most_k"))


SCHEMA = """
SELECT event_type, CASE WHEN NOT json_valid(props) THEN 'not_json' WHEN json_type(props) <> 'OBJECT' THEN 'not_object'
       WHEN coalesce(json_type(props, '$.k'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'k_missing_or_not_integer' WHEN len(json_keys(props)) > 1 THEN 'additional_properties' ELSE 'valid' END AS verdict,
       count(*) AS n, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most_k
FROM events GROUP BY 1, 2
"""

QUERIES = {
    "fk_violations": shared_sql(FK),
    "duplicate_keys": shared_sql(DUPLICATES),
    "partial_groups": shared_sql(PARTIAL),
    "set_relations": shared_sql(SETS),
    "rule_violations": Query(rule_violations, RULES),
    "schema_subset_check": Query(schema_subset_check, SCHEMA),
}
