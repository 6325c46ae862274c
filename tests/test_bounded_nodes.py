"""Nodes in bounded batches, only wanted columns, and trees without joins or broadcasts."""

import contextlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.operators import markup, trees
from loomspark.sources import tables

SF = "/root/testdata/sf0.001"
XML = f"""<Page xmlns="{markup.PRESENTATION}" xmlns:x="{markup.XAML}"><Grid>a<Label x:Name="t" Name="u"/>b</Grid> <Label Content="{{Binding P, Converter={{staticresource k}}}}"/></Page>"""


def plan(rows):
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        rows.explain()
    return held.getvalue()


def test_html_nodes_come_in_bounded_batches():
    page = "<div>" + "<p>x" * 99 + "</div>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": [page, None] * 500})
    sizes = [b.num_rows for b in trees.node_batches([pages, pages])]
    assert sum(sizes) == 1000 * 100 and max(sizes) < trees.BATCH_NODES + 100


def test_wanted_columns_are_those_of_all(spark):
    documents = spark.createDataFrame([("a", XML), ("b", "<x>"), ("c", None)], "source_id string, xml string")
    every = markup.xml_nodes(documents)
    for columns in (["source_id", "error"], ["source_id", "tag", "tail"], ["attributes", "node_path"], ["n_children", "details", "above"]):
        assert markup.xml_nodes(documents, columns).collect() == every.select(*columns).collect()


def test_nested_markup(spark):
    nodes = markup.xml_nodes(spark.createDataFrame([("a", XML)], "source_id string, xml string"), ["source_id", "tag", "node_path", "line", "attributes", "details"])
    assert sorted((r["kind"], r["target"]) for r in markup.references(nodes).collect()) == [("binding", "P"), ("static_resource", "k")]


def test_splice_joins_nothing(spark):
    pages = spark.createDataFrame([(i, "<div><nav><p><b>x</b></p></nav></div><p><div><b>" * (i % 3)) for i in range(40)], "page_id long, html string")
    nodes = trees.html_nodes(pages)
    spliced = trees.splice(nodes, F.col("tag") != "nav")
    assert "Join" not in plan(spliced) and "Broadcast" not in plan(spliced)
    rows = {(r["page_id"], r["ordinal"]): r for r in nodes.collect()}
    want = {}
    for (page, at), r in rows.items():
        up = r["parent"]
        while up is not None and rows[page, up]["tag"] == "nav":
            up = rows[page, up]["parent"]
        if r["tag"] != "nav":
            want[page, at] = up
    assert {(r["page_id"], r["ordinal"]): r["new_parent"] for r in spliced.collect()} == want


@pytest.mark.parametrize("name", ["order_page_inventory", "order_page_resources", "order_page_classes"])
def test_pages_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


def test_keys_are_never_broadcast(spark):
    refs = spark.createDataFrame([("v/a", "/p", 1, "static_resource", "Style", "k", "", "parsed"), ("v/a", "/q", 1, "file_resource", "Source", "../x.png", "", "candidate"), ("v/a", "/r", 1, "file_resource", "Source", "../../x.png", "", "candidate"), ("v/a", "/s", 1, "static_resource", "Style", "v/a", "", "parsed")], "source_id string, node_path string, line long, kind string, attribute string, target string, raw_value string, resolution string")
    files = spark.createDataFrame([("x.png", True)], "file_id string, declared boolean")
    found = markup.resolve(refs, spark.createDataFrame([("k",), ("k",)], "key string"), files)
    assert "SortMergeJoin [met" in plan(found)
    assert sorted((r["node_path"], r["classification"], r["target_exists"], r["target_source_id"]) for r in found.collect()) == [("/p", "resolved_internal_key", True, None), ("/q", "resolved_declared_file", True, "x.png"), ("/r", "external_or_assembly", False, None), ("/s", "unsupported_symbolic_reference", False, None)]


def test_tasks_grow_with_the_input(spark):
    rows = tables.table(spark, SF, "lineitem")
    assert tables.by_key(rows, "l_orderkey", 1000).rdd.getNumPartitions() > tables.by_key(rows, "l_orderkey", 4000).rdd.getNumPartitions() > 4


def test_code_is_never_broadcast(spark):
    from loomspark.queries.matching import _code

    for rows in _code(spark, SF):
        assert "Broadcast" not in plan(rows)


@pytest.mark.parametrize(("name", "passes"), [("order_page_inventory", 2), ("order_page_references", 1), ("order_page_closure", 1)])
def test_pages_are_read_once(spark, name, passes):
    # The inventory has a second pass over the nodes as they were read, which shuffles nothing.
    rows = plan(entry.queries()[name](spark, SF))
    assert rows.count("MapInArrow") == passes
    if name == "order_page_inventory":
        assert rows.count("Exchange") == 2


def tree(rng, depth=0):
    tag = rng.choice(["Grid", "Label", "c:Gauge", "c:RateConverter", "Grid.Resources", "Style", "Odd"])
    text = "".join(tree(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else ""
    keys = "".join(f' {k}="{rng.choice(["", "k", "{StaticResource k}", "{Binding Path=P, Converter={DynamicResource r}}"])}"' for k in ("x:Key", "Name", "Content", "Path") if rng.random() < 0.3)
    return f"<{tag}{keys}>{text}</{tag}>"


def pages(spark, seed, n):
    rng = random.Random(seed)
    head = f'<Page xmlns="{markup.PRESENTATION}" xmlns:x="{markup.XAML}" xmlns:c="clr-namespace:App">'
    return spark.createDataFrame([(f"v/{i}", f"{head}{''.join(tree(rng) for _ in range(rng.randint(0, 3)))}</Page>") for i in range(n)], "source_id string, xml string")


def test_levels_are_those_of_the_control_tree(spark):
    nodes = markup.classify(markup.xml_nodes(pages(spark, 1, 60)).where("error is null"))
    keep = markup.is_migratable(nodes) & ~markup.in_resources()
    got = {}
    for r in markup.levels(nodes.select("source_id", "ordinal", "depth", keep.alias("keep")), "keep").where("level is not null").collect():
        got.setdefault(r["source_id"], {})[r["ordinal"]] = r["level"]
    above = {}
    for r in markup.control_tree(nodes).collect():
        above.setdefault(r["source_id"], {})[r["ordinal"]] = r["new_parent"]
    level = lambda page, at: 0 if page[at] in (None, -1) else 1 + level(page, page[at])
    assert got == {s: {o: level(page, o) for o in page if o >= 0} for s, page in above.items()} and len(got) > 20
    assert any(-1 in page for page in above.values()) and max(max(x.values()) for x in got.values()) > 2


def test_keys_among_references(spark):
    nodes = markup.xml_nodes(pages(spark, 2, 60)).where("error is null")
    keys = nodes.select(markup.key_of(F.col("attributes")).alias("key")).where("key != ''")
    refs = markup.references(nodes)
    both = markup.references(nodes, keys=True)
    assert sorted(both.where("kind != 'key'").collect(), key=str) == sorted(refs.collect(), key=str)
    assert sorted(r["target"] for r in both.where("kind = 'key'").collect()) == sorted(r["key"] for r in keys.collect())
    files = spark.createDataFrame([("x.png", True)], "file_id string, declared boolean")
    want = sorted(markup.resolve(refs, keys, files).collect(), key=str)
    assert sorted(markup.resolve(both, None, files).collect(), key=str) == want
    assert {r["classification"] for r in want} >= {"resolved_internal_key", "dynamic"} and {r["target_exists"] for r in want} == {True, False}
