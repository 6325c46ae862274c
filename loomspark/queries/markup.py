"""UI markup written from the nations table: nodes, references, resources, and rules on paths, names and JSON of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import names as N
from loomspark.functions.schema import json_errors
from loomspark.operators import markup as M
from loomspark.queries.base import Query
from loomspark.sinks import files as S
from loomspark.sources import artefacts as A
from loomspark.sources.tables import table

#: A page for each nation; K is its number, L the next one's, R its remainder by 3, N its name.
PAGE = f"""<?xml version="1.0"?>
<Page xmlns="{M.PRESENTATION}" xmlns:x="{M.XAML}" xmlns:c="clr-namespace:App.Parts" x:Class="App.PageK">
  <!-- <Button Click="Commented"/> -->
  <Page.Resources>
    <Style x:Key="styleK"/>
    <ResourceDictionary><DataTemplate><TextBlock Text="{{Binding Path=Name, Mode=OneWay}}"/></DataTemplate></ResourceDictionary>
    <c:RateConverter x:Key="rate"/>
  </Page.Resources>
  <Grid>
    <Button Content="{{Binding Title}}" Click="OnClick" Style="{{StaticResource styleL}}" Command="{{Binding Save}}"/>
    <Image Source="/img/R.png"/>
    <Image Source="../../../up.png"/>
    <c:Gauge Level="{{DynamicResource rate}}"/>
    <TextBlock>N</TextBlock>
    <Unknown/>
  </Grid>
</Page>"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, xml), and one document that is not well-formed."""
    key = F.col("n_nationkey")
    xml = F.lit(PAGE)
    for mark, value in (("PageK", F.concat(F.lit("Page"), key)), ("styleK", F.concat(F.lit("style"), key)), ("styleL", F.concat(F.lit("style"), key + 1)), ("/R.png", F.concat(F.lit("/"), key % 3, F.lit(".png"))), (">N<", F.concat(F.lit(">"), F.col("n_name"), F.lit("<")))):
        xml = F.replace(xml, F.lit(mark), value.cast("string"))
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("views/N"), key, F.lit(".xaml")).alias("source_id"), xml.alias("xml"))
    return pages.unionByName(spark.range(1).select(F.lit("views/broken.xaml").alias("source_id"), F.lit("<Page><Grid></Page>").alias("xml")))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classify(M.xml_nodes(_documents(spark, sf_dir)).where("error is null"))


def xaml_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return rows.groupBy("source_id", "classification").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("deepest"), F.max("node_path").alias("last_path"))


_IDS = "(SELECT 'views/N' || n_nationkey || '.xaml' AS source_id, n_nationkey AS k, n_name AS n FROM nation) i"
_ROOT, _GRID, _RES = "/Page[1]", "/Page[1]/Grid[1]", "/Page[1]/Page.Resources[1]"
CLASSES = f"""
SELECT source_id, classification, n, deepest, last_path FROM (SELECT source_id FROM {_IDS}), (VALUES
  ('page_or_document_root', 1, 0, '{_ROOT}'), ('property_element', 1, 1, '{_RES}'), ('resource_node', 4, 3, '{_RES}/Style[1]'),
  ('base_control', 5, 4, '{_RES}/ResourceDictionary[1]/DataTemplate[1]/TextBlock[1]'), ('container', 1, 1, '{_GRID}'), ('custom_control', 1, 2, '{_GRID}/Gauge[1]'), ('unsupported_node', 1, 2, '{_GRID}/Unknown[1]')) v(classification, n, deepest, last_path)
"""


def xaml_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.references(M.xml_nodes(_documents(spark, sf_dir)).where("error is null"))
    return found.select("source_id", "node_path", "line", "kind", F.coalesce("attribute", F.lit("")).alias("attribute"), F.coalesce("target", F.lit("")).alias("target"), "resolution")


REFERENCES = f"""
SELECT source_id, path AS node_path, line, kind, attribute, replace(replace(target, 'K', CAST(k + 1 AS VARCHAR)), 'R', CAST(k % 3 AS VARCHAR)) AS target, resolution FROM {_IDS}, (VALUES
  ('{_RES}/ResourceDictionary[1]/DataTemplate[1]/TextBlock[1]', 6, 'binding', 'Text', 'Name', 'parsed'), ('{_GRID}/Button[1]', 10, 'binding', 'Content', 'Title', 'parsed'), ('{_GRID}/Button[1]', 10, 'event_handler', 'Click', 'OnClick', 'parsed'),
  ('{_GRID}/Button[1]', 10, 'static_resource', 'Style', 'styleK', 'parsed'), ('{_GRID}/Button[1]', 10, 'binding', 'Command', 'Save', 'parsed'), ('{_GRID}/Button[1]', 10, 'command', 'Command', '{{Binding Save}}', 'candidate'),
  ('{_GRID}/Image[1]', 11, 'file_resource', 'Source', '/img/R.png', 'candidate'), ('{_GRID}/Image[2]', 12, 'file_resource', 'Source', '../../../up.png', 'candidate'), ('{_GRID}/Gauge[1]', 13, 'dynamic_resource', 'Level', 'rate', 'parsed')) v(path, line, kind, attribute, target, resolution)
"""


def xaml_resource_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a resource or file in one class, none left unexplained."""
    nodes = M.xml_nodes(_documents(spark, sf_dir)).where("error is null")
    keys = nodes.select(F.col("attributes")["Key"].alias("key")).where("key != ''")
    files = spark.createDataFrame([("img/0.png", True), ("img/1.png", False)], "file_id string, declared boolean")
    found = M.resolve(M.references(nodes), keys, files)
    return found.select("source_id", "kind", "classification", "target_exists", F.coalesce("target_source_id", F.lit("")).alias("target_source_id"))


CLOSURE = f"""
WITH i AS (SELECT * FROM {_IDS}), most AS (SELECT max(k) AS m FROM i)
SELECT source_id, 'static_resource' AS kind, CASE WHEN k < m THEN 'resolved_internal_key' ELSE 'unsupported_symbolic_reference' END AS classification, k < m AS target_exists, '' AS target_source_id FROM i, most
UNION ALL SELECT source_id, 'dynamic_resource', 'dynamic', true, '' FROM i
UNION ALL SELECT source_id, 'file_resource', 'external_or_assembly', false, '' FROM i
UNION ALL SELECT source_id, 'file_resource', CASE k % 3 WHEN 0 THEN 'resolved_declared_file' WHEN 1 THEN 'internal_undeclared_file' ELSE 'missing_target' END, k % 3 < 2, 'img/' || (k % 3) || '.png' FROM i
"""


def xaml_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.resources(M.xml_nodes(_documents(spark, sf_dir)).where("error is null"))
    return rows.select("source_id", "index", "tag", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("child_count", F.lit(-1).cast("long")).alias("child_count"), "is_template")


RESOURCES = f"""
SELECT source_id, idx AS "index", tag, replace(key, 'K', CAST(k AS VARCHAR)) AS key, children AS child_count, template AS is_template
FROM {_IDS}, (VALUES (1, 'Style', 'styleK', -1, false), (2, 'DataTemplate', '', 1, true), (3, 'RateConverter', 'rate', -1, false)) v(idx, tag, key, children, template)
"""


def xaml_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    kept = M.inventory(rows).groupBy("source_id", F.col("retention").alias("part")).agg(F.count("*").alias("n"))
    tree = M.control_tree(rows).groupBy("source_id").agg(F.count("*").alias("n"))
    lost = M.placeholders(rows, M.RENAMES).groupBy("source_id").agg(F.count("*").alias("n"))
    return kept.unionByName(tree.select("source_id", F.lit("tree_nodes").alias("part"), "n")).unionByName(lost.select("source_id", F.lit("placeholders").alias("part"), "n"))


INVENTORY = f"SELECT source_id, part, v.n FROM {_IDS}, (VALUES ('root_info', 1), ('control_tree', 6), ('separate_inventory', 7), ('tree_nodes', 6), ('placeholders', 11)) v(part, n)"


def xaml_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.namespaces(_documents(spark, sf_dir))


NAMESPACES = f"SELECT source_id, prefix, uri FROM {_IDS}, (VALUES ('default', '{M.PRESENTATION}'), ('x', '{M.XAML}'), ('c', 'clr-namespace:App.Parts')) v(prefix, uri)"


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files to pages: the exact identity, else the only one that differs in case; several are ambiguous."""
    key, three, six = F.col("c_custkey"), F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 6 == 0
    customers = table(spark, sf_dir, "customer")
    code = customers.select(F.concat(F.when(three, "views/n").otherwise("views/N"), key, F.lit(".xaml.cs")).alias("source_id"))
    pages = customers.select(F.concat(F.lit("views/N"), key, F.lit(".xaml")).alias("page_id")).unionByName(customers.where(six).select(F.concat(F.lit("VIEWS/N"), key, F.lit(".xaml")).alias("page_id")))
    pairs, wrong = A.paired_pages(code.withColumn("page_id", N.page_of(F.col("source_id"))), pages)
    both = pairs.select("source_id", "page_id", F.lit("paired").alias("status")).unionByName(wrong.select("source_id", F.array_join("candidates", "|").alias("page_id"), F.lit("ambiguous").alias("status")))
    return both.withColumn("component", F.when(F.col("status") == "paired", N.component_name(F.col("page_id"))).otherwise(""))


PAIRS = """
SELECT 'views/' || CASE WHEN c_custkey % 3 = 0 THEN 'n' ELSE 'N' END || c_custkey || '.xaml.cs' AS source_id,
       CASE WHEN c_custkey % 6 = 0 THEN 'VIEWS/N' || c_custkey || '.xaml|' ELSE '' END || 'views/N' || c_custkey || '.xaml' AS page_id,
       CASE WHEN c_custkey % 6 = 0 THEN 'ambiguous' ELSE 'paired' END AS status, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'views__N' || c_custkey END AS component FROM customer
"""


def generated_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that documents would be written to: what forbids to write any of them."""
    key = F.col("doc_id")
    suffix = F.when(key % 7 == 0, ".exe").when(key % 7 == 1, ".TSX").otherwise(".ts")
    path = F.concat(F.when(key % 11 == 0, "../").when(key % 11 == 1, "/").when(key % 11 == 2, "node_modules\\").otherwise("src/"), F.pmod(key, F.lit(900)), suffix)
    return S.violations(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))).groupBy("path", "violation").agg(F.count("*").alias("n"))


VIOLATIONS = r"""
WITH f AS (
  SELECT CASE doc_id % 11 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'node_modules\' ELSE 'src/' END || (doc_id % 900) || CASE doc_id % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '.TSX' ELSE '.ts' END AS path, text FROM documents),
g AS (SELECT *, path LIKE 'src/%' AND NOT path LIKE '%.exe' AS ok FROM f)
SELECT path, 'empty file' AS violation, count(*) AS n FROM g WHERE regexp_replace(coalesce(text, ''), '\s', '', 'g') = '' GROUP BY path
UNION ALL SELECT path, 'path not allowed', count(*) FROM g WHERE NOT ok GROUP BY path
UNION ALL SELECT path, 'path given twice', 1 FROM g WHERE ok GROUP BY path HAVING count(*) > 1
"""

SCHEMA = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": ["string", "null"]}, "a": {"type": "array", "items": {"type": "integer"}}}, "additionalProperties": False}


def json_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects against a schema: their own, and with more fields, an array and other top levels."""
    # Equal texts have equal errors: each is parsed once, for as many rows as have it.
    props = table(spark, sf_dir, "events").groupBy("event_type", "props").agg(F.count("*").alias("rows"))
    more = props.select("event_type", "rows", F.explode(F.array(F.col("props"), F.concat(F.lit('{"z": 1, "a": [1, "x", 2.5], "q": '), F.col("props"), F.lit("}")), F.concat(F.lit("["), F.col("props"), F.lit("]")), F.lit("{"))).alias("props"))
    return more.select("event_type", "rows", F.explode(json_errors(F.col("props"), SCHEMA)).alias("error")).groupBy("event_type", "error").agg(F.sum("rows").alias("n"))


ERRORS = """
WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, error, n FROM e, (VALUES ('$.z missing'), ('$.k is not string/null'), ('$.k missing'), ('$.a[1] is not integer'), ('$.a[2] is not integer'), ('$.q undefined'), ('$.z undefined'), ('$ is not an object'), ('$ is not JSON')) v(error)
"""


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings under which an image of each part may be named; every second lies in another assembly."""
    name = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), "p_partkey", F.lit(".png"))
    files = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "/App;component/img/").otherwise(""), name).alias("path"))
    return files.select("p_partkey", F.explode(M.name_variants(F.col("name"), F.col("path"))).alias("variant"))


VARIANTS = """
WITH f AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || p_partkey AS n FROM part)
SELECT p_partkey, unnest(list_distinct([n || '.png', lower(n) || '.png', upper(n) || '.PNG', n, lower(n), upper(n)] || CASE WHEN p_partkey % 2 = 0 THEN ['img/' || n || '.png'] ELSE [] END)) AS variant FROM f
"""


QUERIES = {
    "xaml_classes": Query(xaml_classes, CLASSES),
    "xaml_references": Query(xaml_references, REFERENCES),
    "xaml_resource_closure": Query(xaml_resource_closure, CLOSURE),
    "xaml_resources": Query(xaml_resources, RESOURCES),
    "xaml_inventory": Query(xaml_inventory, INVENTORY),
    "xaml_namespaces": Query(xaml_namespaces, NAMESPACES),
    "page_pairs": Query(page_pairs, PAIRS),
    "generated_violations": Query(generated_violations, VIOLATIONS),
    "json_schema_errors": Query(json_schema_errors, ERRORS),
    "name_variants": Query(name_variants, VARIANTS),
}
