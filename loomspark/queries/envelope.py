"""The deterministic parts of a model call: estimates, history, packing, budgets, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import ledger as L
from loomspark.queries.base import Query, shared_sql
from loomspark.sources.tables import table


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.estimate_light(F.col("text")).alias("light"), L.estimate_safe(F.col("text")).alias("safe"))


ESTIMATES = r"""
WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS cjk, length(text) AS n, strlen(text) AS bytes FROM documents)
SELECT doc_id, CAST(floor(cjk / 1.5e0 + (n - cjk) / 4.0e0) AS BIGINT) AS light, CAST(greatest(1, cjk + ceil((n - cjk) / 4.0e0), ceil(bytes / 4.0e0)) AS BIGINT) AS safe FROM c
"""

TRIM = """
WITH r AS (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END ORDER BY turn DESC) AS back FROM {conversations})
SELECT conv_id, turn, role, CAST(chars AS BIGINT) AS chars FROM r WHERE role = 'system' OR back <= 3
"""

PACK = """
WITH s AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, sum(CAST(length(text) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {conversations})
SELECT conv_id, turn, size, CAST(running AS BIGINT) AS running, turn = 0 OR running <= 1500 AS packed FROM s
"""


def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("asked"))
    return L.budget_fold(rows, "conv_id", "turn", "asked", 1500, 400)


LEDGER = """
WITH RECURSIVE t AS (SELECT conv_id, least(length(text), 400) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(1500 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL SELECT f.conv_id, t.i, rest - least(a, rest), granted + least(a, rest), refused + CASE WHEN rest = 0 THEN 1 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, arg_max(granted, i) AS granted, arg_max(refused, i) AS refused, arg_max(rest, i) AS "left" FROM f GROUP BY conv_id
"""

#: Chunks of 64 within each type; the numbering is a window over a type's rows.
BATCHES = """
WITH r AS (SELECT event_id, event_type, user_id % 16 AS lane, row_number() OVER (PARTITION BY event_type, user_id % 16 ORDER BY event_id) AS i FROM {events})
SELECT event_type, lane, CAST(floor((i - 1) / 64.0E0) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM r GROUP BY event_type, lane, CAST(floor((i - 1) / 64.0E0) AS BIGINT)
"""


def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files under the folder by table and suffix, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sf_dir).select("path", "length")
    name = F.regexp_extract("path", r"/(\w+)\.parquet(/[^/]*)?$", 1)
    return files.groupBy(name.alias("table")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


QUERIES = {
    "token_estimates": Query(token_estimates, ESTIMATES),
    "history_trim": shared_sql(TRIM),
    "context_packing": shared_sql(PACK),
    "budget_ledger": Query(budget_ledger, LEDGER),
    "chunked_batches": shared_sql(BATCHES),
    "scan_inventory": Query(scan_inventory),
}
