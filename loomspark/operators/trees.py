"""Markup as a table of nodes in pre-order, and operators on such tables."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.graph import cut

#: Elements without content, and those that an opening tag of their own kind closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = frozenset("p li option tr td th".split())
NODES = "page_id long, ordinal long, parent long, depth int, tag string, node_path string, text string, n_attributes int, line long"


class _Walker(HTMLParser):
    """Emits a row for each start tag; node_path is the parent's path and Tag[k], k among siblings of the tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.seen: list[Counter] = [Counter()]

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING and self.stack and self.rows[self.stack[-1]][3] == tag:
            self._pop()
        parent = self.stack[-1] if self.stack else None
        self.seen[-1][tag] += 1
        path = f"{self.rows[parent][4] if parent is not None else ''}/{tag}[{self.seen[-1][tag]}]"
        self.rows.append([len(self.rows), parent, len(self.stack), tag, path, "", len(attrs), self.getpos()[0]])
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)
            self.seen.append(Counter())

    def _pop(self):
        self.stack.pop()
        self.seen.pop()

    def handle_endtag(self, tag):
        if any(self.rows[i][3] == tag for i in self.stack):
            while self.stack:
                top = self.rows[self.stack[-1]][3]
                self._pop()
                if top == tag:
                    break

    def handle_data(self, data):
        if self.stack and data.strip():
            self.rows[self.stack[-1]][5] += data.strip()


#: Nodes in a batch that the parser gives back, at least where it has as many; a page's are never split.
BATCH_NODES = 8192


_ARROW = pa.schema([("page_id", pa.int64()), ("ordinal", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("tag", pa.string()), ("node_path", pa.string()), ("text", pa.string()), ("n_attributes", pa.int32()), ("line", pa.int64())])


def node_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of (page_id, html): what is held at once is a batch of nodes and one page, however many pages
    come together."""
    rows: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
    for b in batches:
        for at in range(0, b.num_rows, 16):
            part = b.slice(at, 16)
            for page, html in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True):
                walker = _Walker()
                walker.feed(html or "")
                walker.close()
                rows += [(page, *r) for r in walker.rows]
                if len(rows) >= BATCH_NODES:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


def html_nodes(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> NODES, a row a start tag. Null and empty pages have none."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(node_batches, NODES)


def ancestors(path: Column) -> Column:
    """The tags above a node, nearest first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    tags = F.transform(parts, lambda x: F.regexp_replace(x, r"\[\d+\]$", ""))
    return F.reverse(F.slice(tags, F.lit(1), F.greatest(F.size(tags) - 1, F.lit(0))))


def classify(tag: Column, path: Column) -> Column:
    """One class a node, by ordered rules; the nearest decisive ancestor wins."""
    near = F.filter(ancestors(path), lambda x: x.isin("head", "nav", "article", "footer", "table"))
    nearest = F.try_element_at(near, F.lit(1))
    return (
        F.when(tag.isin("script", "style"), "resource")
        .when(tag.isin("meta", "link", "title", "base"), "metadata")
        .when(tag.isin("html", "head", "body"), "root_info")
        .when(nearest == "nav", "navigation")
        .when(tag.rlike("^h[1-6]$"), "heading")
        .when((nearest == "article") & tag.isin("p", "li", "b", "i", "a"), "content")
        .when(nearest == "table", "tabular")
        .otherwise("container")
    )


def splice(nodes: DataFrame, keep: Column) -> DataFrame:
    """Kept nodes with their nearest kept ancestor: others are taken out and their children move up.

    A page's kept nodes meet in document order, in one shuffle, and a task goes through them with the open ones on a stack: it
    holds as many as a tree is deep, and nothing is joined or broadcast. Paths say what lies below what."""
    kept = nodes.where(keep).select("page_id", "ordinal", "tag", "node_path")
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, ordinal long, new_parent long, tag string, node_path string"

    def run(batches):
        page, above = None, []
        for b in batches:
            new = []
            for now, ordinal, path in zip(b.column("page_id").to_pylist(), b.column("ordinal").to_pylist(), b.column("node_path").to_pylist(), strict=True):
                if now != page:
                    page, above = now, []
                while above and not path.startswith(above[-1][0]):
                    above.pop()
                new.append(above[-1][1] if above else None)
                above.append((f"{path}/", ordinal))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("ordinal"), pa.array(new, pa.int64()), b.column("tag"), b.column("node_path")], ["page_id", "ordinal", "new_parent", "tag", "node_path"])

    return kept.repartition("page_id").sortWithinPartitions("page_id", "ordinal").mapInArrow(run, schema)


def inherit(nodes: DataFrame, keep: Column, value: Column, pruned: Column) -> DataFrame:
    """Kept nodes outside pruned subtrees: (page_id, ordinal, new_parent, tag, node_path, value, inherited).

    new_parent is the nearest kept ancestor. A node without a value (null or empty) takes that of the first of its own
    children, in order, that is not kept and has one; what its kept children have stays theirs, and so does what lies
    deeper. A pruned child may give its value, but nothing below it is kept. nodes (page_id, ordinal, parent, node_path, tag,
    ...); ties cannot be, as ordinals differ. An empty table gives an empty one."""
    flagged = nodes.withColumns({"kept": F.coalesce(keep, F.lit(False)), "given": F.nullif(value, F.lit("")), "cut_off": F.coalesce(pruned, F.lit(False))})
    flagged = flagged.select("page_id", "ordinal", "parent", "tag", "node_path", "kept", "given", "cut_off")
    # One row a parent before the shuffle ends: partial aggregates hold the first child so far.
    first = flagged.where(~F.col("kept") & F.col("given").isNotNull() & F.col("parent").isNotNull()).groupBy("page_id", F.col("parent").alias("ordinal")).agg(F.min_by("given", "ordinal").alias("lent"))
    # A node is below a pruned one if one of its path's prefixes, itself among them, is pruned.
    parts = F.filter(F.split("node_path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), i), "/")))
    tops = flagged.where("cut_off").select("page_id", F.col("node_path").alias("above"))
    below = flagged.where("kept").withColumn("parts", parts).select("page_id", "ordinal", F.explode(prefixes).alias("above")).join(tops, ["page_id", "above"], "left_semi").select("page_id", "ordinal").distinct()
    left = flagged.join(below, ["page_id", "ordinal"], "left_anti")
    held = left.where("kept").join(first, ["page_id", "ordinal"], "left")
    placed = splice(left, F.col("kept")).select("page_id", "ordinal", "new_parent")
    valued = held.select("page_id", "ordinal", "tag", "node_path", F.coalesce("given", "lent", F.lit("")).alias("value"), (F.col("given").isNull() & F.col("lent").isNotNull()).alias("inherited"))
    return valued.join(placed, ["page_id", "ordinal"]).select("page_id", "ordinal", "new_parent", "tag", "node_path", "value", "inherited")


def fold(nodes: DataFrame) -> DataFrame:
    """Per node the size of its subtree, its height and its text's length with that of all below.

    Every node adds to each of its ancestors, found by path prefix: partial sums before the shuffle, and no
    loop over levels."""
    parts = F.filter(F.split("node_path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), i), "/")))
    every = nodes.withColumn("parts", parts).select("page_id", F.explode(prefixes).alias("node_path"), "depth", F.length("text").cast("long").alias("chars"))
    sums = every.groupBy("page_id", "node_path").agg(F.count("*").alias("size"), F.max("depth").alias("deepest"), F.sum("chars").alias("chars"))
    return nodes.join(sums, ["page_id", "node_path"]).select("page_id", "ordinal", "tag", "size", (F.col("deepest") - F.col("depth")).cast("long").alias("height"), "chars")


def fold_ordered(nodes: DataFrame, own: Column, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """nodes (page_id, ordinal, parent, depth, ...) -> (page_id, ordinal, result): own for each node, combined with the
    results of its children as an array in their order; of a leaf with an empty one. result has the type of own.

    From the deepest level up: a level's results meet at their parents in one shuffle of that level alone, and its lineage
    is cut. Where a result holds its children's whole, a root's is as long as its tree."""
    held = cut(nodes.select("page_id", "ordinal", "parent", "depth", own.alias("own")))
    deepest = held.agg(F.max("depth")).first()[0]
    empty = F.array().cast(f"array<{held.schema['own'].dataType.simpleString()}>")
    done = held.where("false").select("page_id", "ordinal", combine(F.col("own"), empty).alias("result"))
    level = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        rows, children = held.where(F.col("depth") == depth), empty
        if level is not None:
            below = level.groupBy("page_id", F.col("parent").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("at"), "result")))["result"].alias("children"))
            rows, children = rows.join(below, ["page_id", "ordinal"], "left"), F.coalesce("children", empty)
        level = cut(rows.select("page_id", "ordinal", "parent", combine(F.col("own"), children).alias("result")))
        done = done.unionByName(level.drop("parent"))
    return done
