"""The trade graph: customer nations to the two supplier nations that they buy most from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import graph as G
from loomspark.operators.retrieval import top_k
from loomspark.queries.base import Query
from loomspark.sources.tables import table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = sold.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    # Two edges a nation: written once, as every query walks them several times.
    return nations, G.cut(top_k(counts, "src", "n", "dst", 2).select("src", "dst"))


EDGES = """
edges AS (
  SELECT src, dst FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM (
      SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE r <= 2)"""


def trade_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(*_graph(spark, sf_dir))


DEGREES = f"""
WITH {EDGES},
o AS (SELECT src AS node, count(*) AS out_degree FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS in_degree FROM edges GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, out_degree IS NULL AND in_degree IS NULL AS isolated
FROM nation LEFT JOIN o ON n_nationkey = o.node LEFT JOIN i ON n_nationkey = i.node
"""


def trade_graph_closure_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    reached = G.closure(edges)
    scc = G.strong_components(nodes, edges)
    return reached.join(scc.withColumnRenamed("node", "src"), "src").select("src", "dst", F.col("scc").alias("src_scc"))


CLOSURE = f"""
WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
scc AS (SELECT a.src AS node, min(a.dst) AS least FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT r.src, r.dst, least(r.src, coalesce(least, r.src)) AS src_scc FROM reach r LEFT JOIN scc ON r.src = node
"""


def trade_graph_condensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return G.condensation(edges, G.strong_components(nodes, edges))


CONDENSATION = f"""
WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
least AS (SELECT a.src AS node, min(a.dst) AS least FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
scc AS (SELECT CAST(n_nationkey AS BIGINT) AS node, least(n_nationkey, coalesce(least, n_nationkey)) AS scc FROM nation LEFT JOIN least ON n_nationkey = node)
SELECT DISTINCT CAST(a.scc AS BIGINT) AS from_scc, CAST(b.scc AS BIGINT) AS to_scc FROM edges JOIN scc a ON src = a.node JOIN scc b ON dst = b.node WHERE a.scc <> b.scc
"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by brand, the customer's nation and the supplier's, with how many came back: written once."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    # The tables that grow least with the orders come first, and brands replace parts before lines meet orders.
    named = items.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    by_order = named.select("l_orderkey", "p_brand", "s_nationkey", "l_returnflag").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = by_order.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return G.cut(sold.groupBy(F.col("p_brand").alias("project"), F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned")))


def _projects(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A project a brand: its nations, and from each that buys to the two others that it buys most from."""
    nodes = sales.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct()
    last = Window.partitionBy("project", "src").orderBy(F.desc("n"), "dst")
    return nodes, sales.where("src != dst").withColumn("rank", F.row_number().over(last)).where("rank <= 2").select("project", "src", "dst")


def trade_graph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest order of every brand's nations in which what a nation buys from comes before it."""
    return G.order_by_project(*_projects(_sales(spark, sf_dir)))


def ordered_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every brand the nations of two regions in its order, with their targets and those not met. A nation fails where
    over a third of its purchases came back, and is open where it buys nothing."""
    sales = _sales(spark, sf_dir)
    nodes, edges = _projects(sales)
    order = G.cut(G.order_by_project(nodes, edges))
    nations = table(spark, sf_dir, "nation").where("n_regionkey in (0, 2)").select(F.col("n_nationkey").cast("long").alias("node"), "n_name")
    asked = sales.select("project", F.explode(F.array("src", "dst")).alias("node")).distinct().join(nations, "node")
    ended = sales.groupBy("project", F.col("src").alias("node")).agg((3 * F.sum("returned") <= F.sum("n")).alias("success"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return G.schedule(order, edges, asked, ended).join(nations, "node").select("project", "node", "n_name", "status", "position", "order_idx", "scc", joined("targets"), joined("unmet"))


def trade_graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nations that reach one another, of two or more."""
    nodes, edges = _graph(spark, sf_dir)
    scc = G.strong_components(nodes, edges)
    groups = scc.groupBy("scc").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members"))
    return groups.where("size > 1")


CYCLES = f"""
WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
scc AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT scc, count(*) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM scc GROUP BY scc HAVING count(*) > 1
"""

QUERIES = {
    "trade_graph_cycles": Query(trade_graph_cycles, CYCLES),
    "trade_graph_degrees": Query(trade_graph_degrees, DEGREES),
    "trade_graph_closure_scc": Query(trade_graph_closure_scc, CLOSURE),
    "trade_graph_condensation": Query(trade_graph_condensation, CONDENSATION),
    "trade_graph_order": Query(trade_graph_order),
    "ordered_projection": Query(ordered_projection),
}
