"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Edges of a rest that one task takes.
SMALL_EDGES = 1 << 17


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, isolated) of every node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = F.lit(0).cast("long")
    held = nodes.join(out, "node", "left").join(into, "node", "left")
    return held.select("node", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"), (F.col("out_degree").isNull() & F.col("in_degree").isNull()).alias("isolated"))


def cut(rows: DataFrame) -> DataFrame:
    """rows written to the cluster's checkpoint folder, without their lineage. Only on one machine, where no folder is
    set, a temporary one will do."""
    sc = rows.sparkSession.sparkContext
    named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomspark-"))
    return rows.checkpoint()


def closure(edges: DataFrame, limit: int = 64) -> DataFrame:
    """All (src, dst) with a path of one or more edges. Paths double in length a round, so rounds are
    logarithmic in the longest path; each round's pairs are distinct and its lineage is cut."""
    reached = cut(edges.select("src", "dst").distinct())
    size = reached.count()
    for _ in range(limit):
        more = reached.alias("a").join(reached.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reached = cut(reached.union(more).distinct())
        if (now := reached.count()) == size:
            return reached
        size = now
    raise RuntimeError(f"the closure has not settled after {limit} rounds")


def _tarjan(edges: DataFrame) -> DataFrame:
    """(node, scc) of the nodes on edges, in one task: for a graph of SMALL_EDGES at most."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        after = defaultdict(set)
        for s, d in zip(rows["src"], rows["dst"], strict=True):
            after[s].add(d)
        group = _strong(sorted(set(after) | {d for v in after.values() for d in v}), after)
        return pd.DataFrame([(n, g[0]) for n, g in group.items()], columns=["node", "scc"])

    return edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, f"node {kind}, scc {kind}")


def _trimmed(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """edges without those that no cycle can use: from a node that none leads to, or to one that none leaves. Goes on as
    long as a round takes away a twentieth."""
    while size:
        left = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = cut(left.select("src", "dst"))
        before, size, edges = size, left.count(), left
        if before - size < before / 20:
            break
    return edges, size


def _settled(rows: DataFrame, step, limit: int, steps: int = 3) -> DataFrame:
    """rows after step, which gives rows and `new`, again and again until it makes no row new; a few steps between cuts."""
    for _ in range(limit):
        for _ in range(steps):
            rows = step(rows.drop("new"))
        rows = cut(rows)
        if rows.where("new").isEmpty():
            return rows.drop("new")
    raise RuntimeError(f"labels have not settled after {limit * steps} rounds")


def strong_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL_EDGES, limit: int = 1000) -> DataFrame:
    """(node, scc): nodes that reach one another have the smallest of them as scc; others themselves.

    Edges that no cycle can use go first. Then every node gets the smallest node that reaches it as its label, and what
    reaches that node back within its label is its component. Components and edges between labels go, and so on with the
    rest. No pair of nodes is made that is not an edge. A rest of `small` edges is solved in one task. Rounds are as many
    as a component's longest shortest path; each is cut off from its lineage."""
    rest = cut(edges.where("src != dst").select("src", "dst").distinct())
    size, found = rest.count(), []
    while size > small:
        rest, size = _trimmed(rest, size)
        if size <= small:
            break
        ends = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct()

        def lower(labels: DataFrame, rest: DataFrame = rest) -> DataFrame:
            into = rest.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("came"))
            return labels.join(into, "node", "left").select("node", F.least("label", F.coalesce("came", "label")).alias("label"), F.coalesce(F.col("came") < F.col("label"), F.lit(False)).alias("new"))

        labels = _settled(ends.withColumn("label", F.col("node")), lower, limit)
        a, b = labels.select(F.col("node").alias("src"), "label"), labels.select(F.col("node").alias("dst"), F.col("label").alias("to_label"))
        inside = cut(rest.join(a, "src").join(b, "dst").where("label = to_label").select("src", "dst", "label"))

        def back(members: DataFrame, inside: DataFrame = inside) -> DataFrame:
            more = inside.join(members.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "label", F.lit(True).alias("new"))
            return members.withColumn("new", F.lit(False)).unionByName(more).groupBy("node", "label").agg(F.min("new").alias("new"))

        members = _settled(labels.where("node = label"), back, limit)
        found.append(members.select("node", F.col("label").alias("scc")))
        gone = members.select("node")
        rest = cut(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        size = rest.count()
    if size:
        found.append(_tarjan(rest))
    if not found:
        return nodes.select("node", F.col("node").alias("scc"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return nodes.join(every, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between different strong components, once each."""
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("from_scc")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("to_scc"))
    return edges.join(a, "src").join(b, "dst").where("from_scc != to_scc").select("from_scc", "to_scc").distinct()


def _strong(nodes: list, after: dict) -> dict:
    """Tarjan's components without recursion: node -> its component's members, sorted."""
    index, low, on, stack, out, count = {}, {}, set(), [], {}, 0
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(sorted(after[root])))]
        index[root] = low[root] = count = count + 1
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = count = count + 1
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(sorted(after[n]))))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == node:
                            break
                    for m in members:
                        out[m] = tuple(sorted(members))
    return out


def dependency_order(nodes: Iterable, edges: Iterable[tuple], isolated_first: bool = False) -> list[tuple]:
    """(node, order from 1, component) with what a node depends on (src depends on dst) before it; of all such
    orders the smallest: components compare by their sorted members, which stay together in name order."""
    nodes = sorted(set(nodes))
    after = defaultdict(set)
    for s, d in edges:
        if s != d:
            after[s].add(d)
    touched = set(after) | {d for v in after.values() for d in v}
    first = [n for n in nodes if n not in touched] if isolated_first else []
    rest = [n for n in nodes if n not in set(first)]
    group = _strong(rest, after)
    waits, frees = defaultdict(set), defaultdict(set)
    for s in rest:
        for d in after[s]:
            if group[s] != group[d]:
                waits[group[s]].add(group[d])
                frees[group[d]].add(group[s])
    ready = [g for g in set(group.values()) if not waits[g]]
    heapq.heapify(ready)
    out = [(n, n) for n in first]
    while ready:
        g = heapq.heappop(ready)
        out += [(n, g[0]) for n in g]
        for other in frees[g]:
            waits[other].discard(g)
            if not waits[other]:
                heapq.heappush(ready, other)
    return [(n, i, c) for i, (n, c) in enumerate(out, 1)]


def order_by_project(nodes: DataFrame, edges: DataFrame, isolated_first: bool = False) -> DataFrame:
    """nodes (project, node), edges (project, src, dst) -> (project, node, order_idx, scc), in one task a project.

    The order is sequential by definition, so a project's graph must fit in a task's memory."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = dependency_order(left["node"], zip(right["src"], right["dst"], strict=True), isolated_first)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["project", "node", "order_idx", "scc"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.groupBy("project").cogroup(edges.groupBy("project")).applyInPandas(run, f"project {nodes.schema['project'].dataType.simpleString()}, node {kind}, order_idx long, scc {kind}")


def schedule(order: DataFrame, edges: DataFrame, requested: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What is asked for, in each project's order: (project, node, status, position, order_idx, scc, targets, unmet).

    order (project, node, order_idx, scc), edges (project, src, dst; src depends on dst), requested (project, node), outcomes
    (project, node, success). Requested nodes keep the order of the whole project and are numbered anew, from 1; repeated
    ones count once. A node that the order does not have is 'unknown', without a place. The others are 'done' or 'failed' by
    their outcome, 'open' without one; a failure stops nothing after it. targets are a node's dependencies, ascending, and
    unmet those that are not done at an earlier place: not requested, later, failed or open. A node's own edge to itself is
    no dependency. Null nodes are left out."""
    asked = requested.select("project", "node").where("node is not null").distinct().join(order.select("project", "node", "order_idx", "scc"), ["project", "node"], "left")
    ended = outcomes.groupBy("project", "node").agg(F.min("success").alias("success"))
    status = F.when(F.col("order_idx").isNull(), "unknown").when(F.col("success"), "done").when(~F.col("success"), "failed").otherwise("open")
    # A project's order was made in one task, so its requested part fits in one as well.
    place = F.when(F.col("order_idx").isNotNull(), F.row_number().over(Window.partitionBy("project").orderBy(F.col("order_idx").asc_nulls_last(), "node")))
    placed = asked.join(ended, ["project", "node"], "left").select("project", "node", status.alias("status"), place.cast("long").alias("position"), "order_idx", "scc")
    waits = edges.where("src != dst").select("project", F.col("src").alias("node"), "dst").distinct().join(placed.select("project", "node", F.col("position").alias("at")), ["project", "node"])
    done = placed.where("status = 'done'").select("project", F.col("node").alias("dst"), F.col("position").alias("before"))
    met = F.coalesce(F.col("before") < F.col("at"), F.lit(False))
    lists = waits.join(done, ["project", "dst"], "left").groupBy("project", "node").agg(F.array_sort(F.collect_list("dst")).alias("targets"), F.array_sort(F.collect_list(F.when(~met, F.col("dst")))).alias("unmet"))
    none = F.array().cast(f"array<{order.schema['node'].dataType.simpleString()}>")
    return placed.join(lists, ["project", "node"], "left").select("project", "node", "status", "position", "order_idx", "scc", F.coalesce("targets", none).alias("targets"), F.coalesce("unmet", none).alias("unmet"))
