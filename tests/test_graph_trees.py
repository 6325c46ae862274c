"""Strong components and folds without an oracle in SQL, against plain versions."""

import hashlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.operators import graph, trees
from loomspark.queries.trees import outlined

SF = "/root/testdata/sf0.001"


def tarjan(nodes, edges):
    after = {n: set() for n in nodes}
    for s, d in edges:
        if s != d:
            after[s].add(d)
    return {n: g[0] for n, g in graph._strong(sorted(nodes), after).items()}


def check(spark, n, edges, small):
    nodes = list(range(n))
    got = graph.strong_components(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"), small)
    assert {r["node"]: r["scc"] for r in got.collect()} == tarjan(nodes, edges) and got.count() == n


def test_components_of_a_random_graph(spark):
    rng = random.Random(6)
    n = 4000
    check(spark, n, [(rng.randrange(n), rng.randrange(n)) for _ in range(7000)], 1000)


@pytest.mark.parametrize("small", [5, 1 << 17])
def test_components_of_odd_graphs(spark, small):
    rng = random.Random(small)
    ring = [(i, (i + 1) % 9) for i in range(9)]
    apart = [(20 + i, 20 + (i + 1) % 4) for i in range(4)] + [(24, 20), (23, 25), (25, 26), (26, 25)]
    some = [(30 + rng.randrange(25), 30 + rng.randrange(25)) for _ in range(45)]
    check(spark, 60, [*ring, (8, 20), (3, 3), (12, 12), (13, 0), *apart, *apart, *some], small)
    check(spark, 5, [], small)


def plain_outline(rows):
    """ordinal -> outline, by going down from each root."""
    children = {}
    for r in rows:
        children.setdefault(r["parent"], []).append(r)

    def outline(r):
        below = [outline(c) for c in sorted(children.get(r["ordinal"], []), key=lambda c: c["ordinal"])]
        return f"{r['tag']}({','.join(below)})" if below else r["tag"]

    return {r["ordinal"]: outline(r) for r in rows}


@pytest.mark.parametrize("depth", [1, 2, 20])
def test_ordered_fold_equals_recursion(spark, depth):
    rng, rows = random.Random(depth), []
    for page in (1, 2):
        last, at = [], 0
        for d in range(depth):
            level = []
            for _ in range(rng.randint(1, 3)):
                level.append(at)
                rows.append((page, at, rng.choice(last) if last else None, d, rng.choice("abc")))
                at += 1
            last = level
    names = ["page_id", "ordinal", "parent", "depth", "tag"]
    folded = trees.fold_ordered(spark.createDataFrame(rows, "page_id long, ordinal long, parent long, depth int, tag string"), F.col("tag"), outlined)
    got = {(r["page_id"], r["ordinal"]): r["result"] for r in folded.collect()}
    for page in (1, 2):
        want = plain_outline([dict(zip(names, r, strict=True)) for r in rows if r[0] == page])
        assert {o: x for (p, o), x in got.items() if p == page} == want
    assert len(got) == len(rows)


def test_fold_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, ordinal long, parent long, depth int, tag string")
    assert trees.fold_ordered(none, F.col("tag"), outlined).collect() == []


def walked(html):
    walker = trees._Walker()
    walker.feed(html or "")
    walker.close()
    return [dict(zip(("ordinal", "parent", "depth", "tag", "node_path", "text", "n_attributes", "line"), r, strict=True)) for r in walker.rows]


def test_tree_outline_on_all_pages(spark):
    got = {(r["page_id"], r["ordinal"]): (r["chars"], r["outline_sha256"]) for r in entry.queries()["tree_outline"](spark, SF).collect()}
    want = {}
    for page in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        for ordinal, x in plain_outline(walked(page["html"])).items():
            want[page["page_id"], ordinal] = (len(x), hashlib.sha256(x.encode()).hexdigest())
    assert got == want and len(want) > 500


def test_tree_fold_on_all_pages(spark):
    """Sizes, heights and texts by walking up from each node."""
    got = {(r["page_id"], r["ordinal"]): (r["size"], r["height"], r["chars"]) for r in entry.queries()["tree_fold"](spark, SF).collect()}
    want = {}
    for page in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        rows = walked(page["html"])
        sums = {r["ordinal"]: [0, 0, 0] for r in rows}
        for r in rows:
            up = r["ordinal"]
            while up is not None:
                sums[up][0] += 1
                sums[up][1] = max(sums[up][1], r["depth"] - rows[up]["depth"])
                sums[up][2] += len(r["text"])
                up = rows[up]["parent"]
        want |= {(page["page_id"], o): tuple(s) for o, s in sums.items()}
    assert got == want


def test_splice_on_all_pages(spark):
    """Each kept node's nearest kept ancestor, by walking up."""
    kept = {(r["page_id"], r["ordinal"]): r["new_parent"] for r in entry.queries()["html_splice_controls"](spark, SF).collect()}
    for page in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        rows = walked(page["html"])
        for r in rows:
            if (page["page_id"], r["ordinal"]) in kept:
                up = r["parent"]
                while up is not None and (page["page_id"], up) not in kept:
                    up = rows[up]["parent"]
                assert kept[page["page_id"], r["ordinal"]] == up
