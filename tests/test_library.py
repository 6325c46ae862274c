import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.functions.ratios import micro_rate, passes, safe_ratio
from loomspark.operators import graph, ledger, retrieval, trees

SF = "/root/testdata/sf0.001"


def test_order_and_cycles():
    rows = graph.dependency_order("ABCD", [("A", "B"), ("B", "A"), ("C", "B")], isolated_first=True)
    assert [r[0] for r in rows] == ["D", "A", "B", "C"]
    assert [r[0] for r in rows if r[2] == "A"] == ["A", "B"]
    # A and B independent, AA after A: the smallest order is not the order by level.
    assert [r[0] for r in graph.dependency_order(["A", "B", "AA"], [("AA", "A")])] == ["A", "AA", "B"]


def test_closure_and_components(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "B")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "node string")
    reached = graph.closure(edges)
    assert {tuple(r) for r in reached.collect()} == {("A", "A"), ("A", "B"), ("B", "A"), ("B", "B"), ("C", "A"), ("C", "B")}
    scc = graph.strong_components(nodes, reached)
    assert {tuple(r) for r in scc.collect()} == {("A", "A"), ("B", "A"), ("C", "C"), ("D", "D")}
    assert {tuple(r) for r in graph.condensation(edges, scc).collect()} == {("C", "A")}
    isolated = {r["node"] for r in graph.degrees(nodes, edges).where("isolated").collect()}
    assert isolated == {"D"}


def test_rates(spark):
    df = spark.createDataFrame([("a", 9, 10), ("b", 89, 100), ("c", 100, 100), ("d", 5, 0), ("e", 12, 10)], "p string, handled long, total long")
    rates = {r["p"]: r["rate"] for r in df.groupBy("p").agg(micro_rate(F.col("handled"), F.col("total")).alias("rate")).collect()}
    assert rates == {"a": 0.9, "b": 0.89, "c": 1.0, "d": 1.0, "e": 1.0}
    ok = df.groupBy("p").agg(passes(micro_rate(F.col("handled"), F.col("total")), 0.9).alias("ok"))
    assert {r["p"] for r in ok.where("ok").collect()} == {"a", "c", "d", "e"}
    row = spark.range(1).select(safe_ratio(F.lit(1), F.lit(0)).alias("a"), safe_ratio(F.lit(1), F.lit(2), F.lit(False)).alias("b"), safe_ratio(F.lit(1), F.lit(2)).alias("c")).first()
    assert tuple(row) == (None, None, 0.5)


def test_tokens_and_estimates(spark):
    row = spark.createDataFrame([("DataGridRow 中文字 x",)], "t string").select(retrieval.tokens(F.col("t")).alias("w"), ledger.estimate_light(F.col("t")).alias("l"), ledger.estimate_safe(F.col("t")).alias("s")).first()
    assert row["w"] == ["data", "grid", "row", "中文字", "中文", "文字", "x"]
    assert (row["l"], row["s"]) == (5, 7)


def test_budget(spark):
    rows = spark.createDataFrame([(1, 0, 300), (1, 1, 900), (1, 2, 500), (1, 3, 10)], "g int, o int, a int")
    assert tuple(ledger.budget_fold(rows, "g", "o", "a", 1000, 400).first()) == (1, 1000, 1, 0)


def test_nodes_splice_fold(spark):
    pages = spark.createDataFrame([(1, "<html><body><p>a<p>b<br><div><b>c</b></div></body></html>"), (2, None), (3, "")], "page_id long, html string")
    nodes = trees.html_nodes(pages)
    paths = [r["node_path"] for r in nodes.orderBy("ordinal").collect()]
    assert paths[:4] == ["/html[1]", "/html[1]/body[1]", "/html[1]/body[1]/p[1]", "/html[1]/body[1]/p[2]"]
    kept = trees.splice(nodes, F.col("tag").isin("html", "b"))
    assert {(r["tag"], r["new_parent"]) for r in kept.collect()} == {("html", None), ("b", 0)}
    root = trees.fold(nodes).where("tag = 'html'").first()
    assert root["size"] == nodes.count() and root["chars"] == 3


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    if name.startswith("op"):
        pytest.skip("in tests/llm")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine = entry.queries()[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = con.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry.oracle_sql()[name].rstrip().rstrip(';')}) q").fetchall()
    clean = lambda rows: sorted(repr(tuple(round(float(x), 5) if isinstance(x, (int, float)) else x for x in r)) for r in rows)
    assert clean(tuple(r) for r in mine.select(*cols).collect()) == clean(theirs)


def test_reference_headings_are_whole(spark, tmp_path):
    head = "forty characters that both headings share"
    html = f"<h1>{head} one</h1><h2>{head} two</h2><p>x</p><h2>{head} two</h2><h3></h3>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = entry.queries()["reference_extraction"](spark, str(tmp_path)).collect()
    assert {(r["kind"], r["target"], r["n"]) for r in rows} == {("heading", f"{head} one", 1), ("heading", f"{head} two", 2), ("heading", "", 1)}


def test_page_status_gate_reaches_every_document(spark, tmp_path):
    spark.createDataFrame([(7, "en"), (4033, "en"), (4034, "de"), (4035, "en")], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    urls = ["http://m.a.example/en/4033.html", "https://b.example/de/4034?page=2", "http://c.example/de/4034#top", "http://a.example/de/4035", "http://a.example/about", None]
    spark.createDataFrame([(i + 7, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = entry.queries()["page_status_gate"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {(7, 0, "NOT_FOUND"), (4033, 1, "MATCHED"), (4034, 2, "AMBIGUOUS"), (4035, 0, "NOT_FOUND")}


def test_rows_only_queries_run_twice_alike(spark):
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        if not name.startswith("op") and name != "pipeline" and name != "scan_inventory":
            one, two = (sorted(map(repr, entry.queries()[name](spark, SF).collect())) for _ in range(2))
            assert one and one == two, name


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
