"""The queries over pages' trees against a plain second version: a pattern for tokens and recursion over nested nodes."""

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.operators import cascade, trees

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"<!--.*?-->|<!.*?>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>|(?P<text>[^<]+)|<", re.S)
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSING = {"p", "li", "option", "tr", "td", "th"}


def forest(source):
    """All nodes in pre-order; each has its parent, children, tag, text and path."""
    every, above, at = [], [], 0
    top = {"children": [], "path": ""}
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m["text"] is not None:
            if above and m["text"].strip():
                above[-1]["text"] += entities.unescape(m["text"]).strip()
        elif m["tag"] and m["end"]:
            tag = m["tag"].lower()
            if tag in [n["tag"] for n in above]:
                while above.pop()["tag"] != tag:
                    pass
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in CLOSING and above and above[-1]["tag"] == tag:
                above.pop()
            parent = above[-1] if above else top
            k = 1 + sum(c["tag"] == tag for c in parent["children"])
            node = {"at": len(every), "tag": tag, "text": "", "children": [], "up": [*above], "path": f"{parent['path']}/{tag}[{k}]", "line": source.count("\n", 0, m.start()) + 1}
            every.append(node)
            parent["children"].append(node)
            if tag not in EMPTY:
                above.append(node)
            if tag in ("script", "style"):
                stop = re.compile(f"</{tag}", re.I).search(source, at)
                stop = stop.start() if stop else len(source)
                node["text"] += source[at:stop].strip()
                at = stop
    return every


def kind(node):
    tag, near = node["tag"], [n["tag"] for n in reversed(node["up"]) if n["tag"] in ("head", "nav", "article", "footer", "table")]
    nearest = near[0] if near else None
    if tag in ("script", "style"):
        return "resource"
    if tag in ("meta", "link", "title", "base"):
        return "metadata"
    if tag in ("html", "head", "body"):
        return "root_info"
    if nearest == "nav":
        return "navigation"
    if re.fullmatch("h[1-6]", tag):
        return "heading"
    if nearest == "article" and tag in ("p", "li", "b", "i", "a"):
        return "content"
    return "tabular" if nearest == "table" else "container"


@pytest.fixture(scope="module")
def plain():
    table = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    return {r["page_id"]: forest(r["html"] or "") for r in table}


def got(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


def test_nodes(spark, plain):
    rows = {(r["page_id"], r["ordinal"], r["parent"], r["depth"], r["tag"], r["node_path"], r["text"], r["line"]) for r in got(spark, "html_nodes")}
    assert rows == {(p, n["at"], n["up"][-1]["at"] if n["up"] else None, len(n["up"]), n["tag"], n["path"], n["text"], n["line"]) for p, nodes in plain.items() for n in nodes}


def test_classes(spark, plain):
    found = Counter((kind(n), n["tag"]) for nodes in plain.values() for n in nodes)
    pages = Counter(k for nodes in plain.values() for k in {(kind(n), n["tag"]) for n in nodes})
    assert {(r["classification"], r["tag"]): (r["n"], r["pages"]) for r in got(spark, "html_classify")} == {k: (n, pages[k]) for k, n in found.items()}


def test_splice(spark, plain):
    def kept(n):
        return kind(n) not in ("resource", "metadata", "container")

    want = {(p, n["at"], next((u["at"] for u in reversed(n["up"]) if kept(u)), None), n["path"]) for p, nodes in plain.items() for n in nodes if kept(n)}
    assert {(r["page_id"], r["ordinal"], r["new_parent"], r["node_path"]) for r in got(spark, "html_splice_controls")} == want


def test_fold(spark, plain):
    def measure(n):
        below = [measure(c) for c in n["children"]]
        n["sums"] = (1 + sum(b[0] for b in below), 1 + max((b[1] for b in below), default=-1), len(n["text"]) + sum(b[2] for b in below))
        return n["sums"]

    for nodes in plain.values():
        for n in nodes:
            if not n["up"]:
                measure(n)
    assert {(r["page_id"], r["ordinal"]): (r["size"], r["height"], r["chars"]) for r in got(spark, "tree_fold")} == {(p, n["at"]): n["sums"] for p, nodes in plain.items() for n in nodes}


def test_raw_against_nodes(spark, plain):
    ir = Counter(n["tag"] for nodes in plain.values() for n in nodes)
    raw = Counter(t for r in pq.read_table(f"{SF}/pages.parquet").to_pylist() for t in re.findall(r"<([a-z][a-z0-9]*)[\s>/]", r["html"] or ""))
    want = {t: (raw[t], ir[t], min(raw[t], ir[t]), max(0, raw[t] - ir[t])) for t in {*raw, *ir}}
    assert {r["tag"]: (r["raw"], r["ir"], r["handled"], r["gap"]) for r in got(spark, "raw_vs_ir_closure")} == want


def extracted(node, keep, value, pruned, out, holder=None):
    """Recursion that the join by paths must equal: kept nodes, their holder, their value or the first lent one."""
    if pruned(node):
        return
    if keep(node):
        lent = next((value(c) for c in node["children"] if not keep(c) and value(c)), "")
        out[node["at"]] = (holder, value(node) or lent, not value(node) and bool(lent))
        holder = node["at"]
    for c in node["children"]:
        extracted(c, keep, value, pruned, out, holder)


def test_inherited(spark, plain):
    want = {}
    for p, nodes in plain.items():
        out = {}
        for n in nodes:
            if not n["up"]:
                extracted(n, lambda x: kind(x) not in ("resource", "metadata", "container", "heading"), lambda x: x["text"], lambda x: x["tag"] == "nav", out)
        want |= {(p, at): (-1 if up is None else up, hashlib.sha256(v.encode()).hexdigest(), lent) for at, (up, v, lent) in out.items()}
    rows = got(spark, "html_inherited")
    assert {(r["page_id"], r["ordinal"]): (r["new_parent"], r["value_sha256"], r["inherited"]) for r in rows} == want and len(rows) == len(want)
    assert any(lent for _, _, lent in want.values()) and not all(lent for _, _, lent in want.values())


def test_inherited_small(spark):
    """Nulls, a pruned child that lends, nested kept nodes, the first of several, and an empty table."""
    rows = [
        (1, 0, None, "a[1]", "keep", None), (1, 1, 0, "a[1]/r[1]", "drop", "lent"), (1, 2, 1, "a[1]/r[1]/k[1]", "keep", "gone"), (1, 3, 0, "a[1]/d[1]", "drop", "later"),
        (2, 0, None, "a[1]", "keep", ""), (2, 1, 0, "a[1]/k[1]", "keep", "own"), (2, 2, 0, "a[1]/d[1]", "drop", None), (2, 3, 2, "a[1]/d[1]/d[1]", "drop", "deep"), (2, 4, 3, "a[1]/d[1]/d[1]/k[1]", "keep", None),
    ]
    nodes = spark.createDataFrame([(p, o, u, path.rsplit("/", 1)[-1][0], "/" + path, k, v) for p, o, u, path, k, v in rows], "page_id long, ordinal long, parent long, tag string, node_path string, kind string, value string")
    args = F.col("kind") == "keep", F.col("value"), F.col("tag") == "r"
    found = {(r["page_id"], r["ordinal"]): (r["new_parent"], r["value"], r["inherited"]) for r in trees.inherit(nodes, *args).collect()}
    assert found == {(1, 0): (None, "lent", True), (2, 0): (None, "", False), (2, 1): (0, "own", False), (2, 4): (0, "", False)}
    assert trees.inherit(nodes.where("false"), *args).count() == 0


def test_symbol_scopes(spark):
    """Each step, the page itself left out, comments, a use over two lines, and a symbol that none declares."""
    classes = spark.createDataFrame([("p1", "One", "A"), ("p2", "Two", "A"), ("p3", "Two", "B.C"), ("p4", "Two", "D"), ("p5", "Me", "A"), ("p6", "Me", "Z"), ("p7", "Alone", "A")], "page string, symbol string, namespace string")
    code = {
        "p1": "new Two ();\nnew B.C.Two{}; new Two()", "p5": "// new One()\n\nvar x = new\n Me(); new Nothing(); /* new Two() */", "p4": " using  B.C ;\nnew One(1); new  Two()", "p7": "new Alone(); newTwo(); new Two{}",
    }
    files = spark.createDataFrame([(p, {"p1": "Q", "p5": "A", "p4": "D", "p7": "D"}[p], c) for p, c in code.items()] + [("p9", "A", None)], "page string, namespace string, content string")
    rows = cascade.resolve_scopes(cascade.symbol_uses(files, ["page", "namespace"]), classes, ["page"]).collect()
    assert {(r["page"], r["symbol"]): (r["line"], r["target"], r["step"], r["candidates"]) for r in rows} == {
        ("p1", "Two"): (1, "p3", "qualified_symbol", 3),
        ("p5", "Me"): (3, "p6", "unique_symbol", 1),
        ("p4", "One"): (2, "p1", "unique_symbol", 1),
        ("p4", "Two"): (2, "p3", "imported_namespace", 2),
        ("p7", "Two"): (1, "p4", "same_namespace", 3),
    }
    assert cascade.resolve_scopes(cascade.symbol_uses(files.where("false"), ["page", "namespace"]), classes, ["page"]).count() == 0


def test_symbol_pages(spark):
    """Variants, quotes, two names of one page, a symbol without pages, repeats, nulls and an empty table."""
    pages = spark.createDataFrame([(1, "User", "User"), (2, "UserModel", "Other"), (3, None, "User"), (4, "", "Model")], "page long, class_name string, stem string")
    symbols = spark.createDataFrame([("'App.UserModel'",), ("User",), ("User",), ("Nobody",), (None,), ("Model",)], "symbol string")
    got = {r["symbol"]: r["pages"] for r in cascade.symbol_pages(symbols, pages).collect()}
    assert got == {"'App.UserModel'": [1, 2, 3], "User": [1, 3], "Nobody": [], "Model": [4]}
    assert cascade.symbol_pages(symbols.where("false"), pages).count() == 0
