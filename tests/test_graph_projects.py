"""Orders and schedules of many projects against plain versions over the same tables."""

from collections import Counter, defaultdict
from itertools import permutations

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from loomspark.operators import graph

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def sales():
    customer = {r["o_orderkey"]: r["o_custkey"] for r in rows("orders")}
    nation = {r["c_custkey"]: r["c_nationkey"] for r in rows("customer")}
    seller = {r["s_suppkey"]: r["s_nationkey"] for r in rows("supplier")}
    brand = {r["p_partkey"]: r["p_brand"] for r in rows("part")}
    n, back = Counter(), Counter()
    for r in rows("lineitem"):
        if r["l_orderkey"] in customer and customer[r["l_orderkey"]] in nation and r["l_suppkey"] in seller and r["l_partkey"] in brand:
            key = brand[r["l_partkey"]], nation[customer[r["l_orderkey"]]], seller[r["l_suppkey"]]
            n[key] += 1
            back[key] += r["l_returnflag"] == "R"
    return n, back


def projects(n):
    nodes, best = defaultdict(set), defaultdict(list)
    for (brand, src, dst), count in n.items():
        nodes[brand] |= {src, dst}
        if src != dst:
            best[brand, src].append((-count, dst))
    edges = defaultdict(set)
    for (brand, src), found in best.items():
        edges[brand] |= {(src, dst) for _, dst in sorted(found)[:2]}
    return nodes, edges


def test_orders(spark, sales):
    nodes, edges = projects(sales[0])
    got = {(r["project"], r["node"]): (r["order_idx"], r["scc"]) for r in entry.queries()["trade_graph_order"](spark, SF).collect()}
    assert got == {(b, x): (i, c) for b in nodes for x, i, c in graph.dependency_order(nodes[b], edges[b])}
    assert len(nodes) > 5


def test_smallest_order_of_all(spark):
    """Against every permutation: what is depended on comes first, and no smaller order is right."""
    nodes, edges = "abcdef", {("a", "f"), ("b", "f"), ("e", "c"), ("c", "e")}
    order = [x for x, _, _ in graph.dependency_order(nodes, edges)]

    def right(p):
        at = {x: i for i, x in enumerate(p)}
        return at["f"] < at["a"] and at["f"] < at["b"] and at["e"] == at["c"] + 1

    assert tuple(order) == min(p for p in permutations(nodes) if right(p))


def test_projection(spark, sales):
    n, back = sales
    nodes, edges = projects(n)
    names = {r["n_nationkey"]: r["n_name"] for r in rows("nation") if r["n_regionkey"] in (0, 2)}
    want = set()
    for brand in nodes:
        order = [(x, i, c) for x, i, c in graph.dependency_order(nodes[brand], edges[brand]) if x in names]
        done = []
        for place, (x, i, c) in enumerate(order, 1):
            bought = sum(v for (b, s, _), v in n.items() if (b, s) == (brand, x))
            came = sum(v for (b, s, _), v in back.items() if (b, s) == (brand, x))
            status = "open" if not bought else "done" if 3 * came <= bought else "failed"
            targets = sorted(d for s, d in edges[brand] if s == x)
            want.add((brand, x, names[x], status, place, i, c, ",".join(map(str, targets)), ",".join(str(d) for d in targets if d not in done)))
            if status == "done":
                done.append(x)
    got = [tuple(r[c] for c in ("project", "node", "n_name", "status", "position", "order_idx", "scc", "targets", "unmet")) for r in entry.queries()["ordered_projection"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {w[3] for w in want} >= {"done", "failed"}


def test_schedule_odd_cases(spark):
    """An unknown node, a failure that stops nothing, a cycle, a self edge, repeats, an open node, two projects, none."""
    order = spark.createDataFrame([("p", "a", 1, "a"), ("p", "b", 2, "b"), ("p", "c", 3, "b"), ("p", "d", 4, "d"), ("q", "a", 1, "a")], "project string, node string, order_idx long, scc string")
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "b", "c"), ("p", "c", "b"), ("p", "d", "b"), ("p", "d", "d"), ("p", "d", "a"), ("p", "d", "a")], "project string, src string, dst string")
    asked = spark.createDataFrame([("p", "d"), ("p", "a"), ("p", "b"), ("p", "b"), ("p", "x"), ("p", None), ("q", "a"), ("q", "b")], "project string, node string")
    ended = spark.createDataFrame([("p", "a", True), ("p", "b", False), ("p", "d", True)], "project string, node string, success boolean")
    got = {(r["project"], r["node"]): (r["status"], r["position"], r["targets"], r["unmet"]) for r in graph.schedule(order, edges, asked, ended).collect()}
    assert got == {
        ("p", "a"): ("done", 1, [], []),
        ("p", "b"): ("failed", 2, ["a", "c"], ["c"]),
        ("p", "d"): ("done", 3, ["a", "b"], ["b"]),
        ("p", "x"): ("unknown", None, [], []),
        ("q", "a"): ("open", 1, [], []),
        ("q", "b"): ("unknown", None, [], []),
    }
    assert graph.schedule(order, edges, asked.where("false"), ended).count() == 0
