"""Markup trees of the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import trees as T
from loomspark.queries.base import Query
from loomspark.sources.tables import spread, table

TAG = r"<([a-z][a-z0-9]*)[\s>/]"


def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(TAG), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


COUNTS = f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '{TAG}', 1)) AS tag FROM pages) GROUP BY tag"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.html_nodes(spread(table(spark, sf_dir, "pages").select("page_id", "html")))


def html_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).withColumn("classification", T.classify(F.col("tag"), F.col("node_path")))
    return rows.groupBy("classification", "tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def html_splice_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ~T.classify(F.col("tag"), F.col("node_path")).isin("resource", "metadata", "container")
    return T.splice(_nodes(spark, sf_dir), keep)


def html_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept nodes with their own text, else that of the first child that is not kept; navigation is pruned."""
    nodes = _nodes(spark, sf_dir)
    keep = ~T.classify(F.col("tag"), F.col("node_path")).isin("resource", "metadata", "container", "heading")
    rows = T.inherit(nodes, keep, F.col("text"), F.col("tag") == "nav")
    return rows.select("page_id", "ordinal", F.coalesce("new_parent", F.lit(-1)).alias("new_parent"), "tag", "inherited", F.sha2("value", 256).alias("value_sha256"))


def tree_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fold(_nodes(spark, sf_dir))


def outlined(own: Column, children: Column) -> Column:
    """tag(child,child): a node's outline holds its children's whole, in their order."""
    return F.when(F.size(children) == 0, own).otherwise(F.concat(own, F.lit("("), F.array_join(children, ","), F.lit(")")))


def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's trees as outlines of their tags: a fold that depends on the children's order."""
    nodes = _nodes(spark, sf_dir)
    folded = T.fold_ordered(nodes, F.col("tag"), outlined).withColumnRenamed("result", "outline")
    return folded.select("page_id", "ordinal", F.length("outline").cast("long").alias("chars"), F.sha2("outline", 256).alias("outline_sha256"))


def raw_vs_ir_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags that a pattern finds against those that the parser made nodes of, and the handled share."""
    raw = html_tag_counts(spark, sf_dir).select("tag", F.col("n").alias("raw"))
    ir = _nodes(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("ir"))
    zero = F.lit(0).cast("long")
    both = raw.join(ir, "tag", "full").select("tag", F.coalesce("raw", zero).alias("raw"), F.coalesce("ir", zero).alias("ir"))
    return both.withColumn("handled", F.least("raw", "ir")).withColumn("gap", F.greatest(zero, F.col("raw") - F.col("ir")))


QUERIES = {
    "html_tag_counts": Query(html_tag_counts, COUNTS),
    "html_nodes": Query(_nodes),
    "html_classify": Query(html_classify),
    "html_splice_controls": Query(html_splice_controls),
    "html_inherited": Query(html_inherited),
    "tree_fold": Query(tree_fold),
    "tree_outline": Query(tree_outline),
    "raw_vs_ir_closure": Query(raw_vs_ir_closure),
}
