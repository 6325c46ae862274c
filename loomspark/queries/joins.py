"""Joins, splits, merges and lookups in which keys may be missing, ambiguous or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.queries.base import Query, shared_sql
from loomspark.sources.tables import table

SPLIT = """
WITH a AS (SELECT p_partkey, concat(p_brand, '::', p_type, '::', CAST(p_size AS STRING)) AS id FROM {part}),
d AS (SELECT DISTINCT concat(p_brand, '::', p_type, '::', CAST(p_size AS STRING)) AS id FROM {part} WHERE p_size > 40),
t AS (SELECT DISTINCT concat(p_brand, '::', p_type, '::', CAST(p_size AS STRING)) AS id FROM {part} WHERE p_retailprice < 950)
SELECT p_partkey, id, CASE WHEN id IN (SELECT id FROM d) THEN 'data' WHEN id IN (SELECT id FROM t) THEN 'template' ELSE 'general' END AS target FROM a
"""

FIRST_LAST = """
WITH r AS (
  SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) AS up, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id DESC) AS down FROM {events})
SELECT user_id, event_type, min(CASE WHEN up = 1 THEN event_id END) AS first_event, min(CASE WHEN down = 1 THEN event_id END) AS last_event,
       min(CASE WHEN up = 1 THEN value END) AS first_value, min(CASE WHEN down = 1 THEN value END) AS last_value, count(*) AS n
FROM r GROUP BY user_id, event_type
"""

#: New rows by key replace old ones, the rest is appended; the right side wins whole.
UPSERT = """
WITH old AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM {customer}), new AS (SELECT s_suppkey * 3 AS k, s_name AS name, s_acctbal AS bal FROM {supplier})
SELECT k, name, bal, 'kept' AS origin FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.k = old.k)
UNION ALL SELECT new.k, new.name, new.bal, CASE WHEN old.k IS NULL THEN 'appended' ELSE 'replaced' END FROM new LEFT JOIN old ON new.k = old.k
"""

BOUNDARY = """
WITH e AS (
  SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey),
chosen AS (SELECT n_nationkey FROM {nation} WHERE n_regionkey IN (0, 2))
SELECT src, dst, CASE WHEN dst IN (SELECT n_nationkey FROM chosen) THEN 'inside' ELSE 'boundary' END AS side FROM e WHERE src IN (SELECT n_nationkey FROM chosen)
"""

LOOKUP = """
WITH k AS (SELECT l_partkey, count(*) AS evidence, min(l_suppkey) AS first_supplier, max(l_suppkey) AS last_supplier FROM {lineitem} GROUP BY l_partkey)
SELECT p_partkey, coalesce(evidence, 0) AS evidence, coalesce(first_supplier, -1) AS first_supplier, coalesce(last_supplier, -1) AS last_supplier, f.s_name AS first_name, CASE WHEN evidence IS NULL THEN 'unresolved' WHEN evidence = 1 THEN 'unique' ELSE 'many' END AS resolution
FROM {part} LEFT JOIN k ON p_partkey = l_partkey LEFT JOIN {supplier} f ON k.first_supplier = f.s_suppkey
"""

USAGE_PATHS = """
WITH direct AS (SELECT s_suppkey, n_nationkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
sibling AS (SELECT s_suppkey, b.n_nationkey FROM direct JOIN {nation} a ON direct.n_nationkey = a.n_nationkey JOIN {nation} b ON a.n_regionkey = b.n_regionkey),
every AS (SELECT s_suppkey, n_nationkey, 'direct' AS how FROM direct UNION SELECT s_suppkey, n_nationkey, 'region' FROM sibling),
customers AS (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey)
SELECT s_suppkey, count(DISTINCT n_nationkey) AS nations, count(CASE WHEN how = 'direct' THEN 1 END) AS direct, count(CASE WHEN how = 'region' THEN 1 END) AS indirect, CAST(sum(CASE WHEN how = 'region' THEN n ELSE 0 END) AS BIGINT) AS customers
FROM every LEFT JOIN customers ON n_nationkey = c_nationkey GROUP BY s_suppkey
"""

MANIFEST = """
WITH doc AS (SELECT doc_id, lang, source FROM {documents}), page AS (SELECT page_id FROM {pages}),
listed AS (SELECT page_id AS id, 1 AS pri FROM page UNION ALL SELECT doc_id, 2 FROM {labels}),
once AS (SELECT id, min(pri) AS pri FROM listed GROUP BY id)
SELECT id, CASE WHEN pri = 1 THEN 'page' ELSE 'label' END AS origin, lang, source, coalesce(quality, -1) AS quality, CASE WHEN lang IS NULL THEN 'unknown' ELSE concat(lang, '/', source) END AS hint
FROM once LEFT JOIN doc ON id = doc.doc_id LEFT JOIN {labels} l ON id = l.doc_id
"""

#: Pages belong to the document whose language and number their URL has.
GATE = """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1) AS lang, TRY_CAST(regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 2) AS BIGINT) AS doc_id FROM {pages}),
n AS (SELECT d.doc_id, count(p.page_id) AS candidates FROM {documents} d LEFT JOIN p ON d.doc_id = p.doc_id AND d.lang = p.lang GROUP BY d.doc_id)
SELECT doc_id, candidates, CASE WHEN candidates = 0 THEN 'NOT_FOUND' WHEN candidates = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status FROM n
"""
REPORT = """
SELECT r_name, concat('## ', r_name, chr(10), string_agg(concat('- ', n_name), chr(10) ORDER BY n_name)) AS report, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name
"""


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("n_name")))), "\n")
    return nations.groupBy("r_name").agg(F.concat(F.lit("## "), F.first("r_name"), F.lit("\n"), lines).alias("report"), F.count("*").alias("n"))


def tagged_union_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different kinds as one table: a tag, an id, and the rest as JSON with keys in a fixed order."""
    labels = table(spark, sf_dir, "labels").select(F.lit("label").alias("unit_type"), F.col("doc_id").alias("id"), F.to_json(F.struct("quality", "toxic")).alias("result"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("unit_type"), F.col("conv_id").alias("id"), F.to_json(F.struct("turn", "role")).alias("result"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("unit_type"), F.col("event_id").alias("id"), F.to_json(F.struct("user_id", "event_type")).alias("result"))
    return labels.unionByName(turns).unionByName(events)


TAGGED = """
SELECT 'label' AS unit_type, doc_id AS id, CAST(to_json({'quality': quality, 'toxic': toxic}) AS VARCHAR) AS result FROM labels
UNION ALL SELECT 'turn', conv_id, CAST(to_json({'turn': turn, 'role': role}) AS VARCHAR) FROM conversations
UNION ALL SELECT 'event', event_id, CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS VARCHAR) FROM events
"""

QUERIES = {
    "three_way_split": shared_sql(SPLIT),
    "first_last_wins": shared_sql(FIRST_LAST),
    "upsert_merge": shared_sql(UPSERT),
    "boundary_edges": shared_sql(BOUNDARY),
    "key_lookup_evidence": shared_sql(LOOKUP),
    "direct_or_indirect_usage": shared_sql(USAGE_PATHS),
    "manifest_build": shared_sql(MANIFEST),
    "page_status_gate": shared_sql(GATE),
    "markdown_report": Query(markdown_report, REPORT),
    "tagged_union_records": Query(tagged_union_records, TAGGED),
}
