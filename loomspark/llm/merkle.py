"""Merkle manifest of a table: a digest for every row, one for every language, one for all, and proofs.

Rows get their digests in built-in functions and their places in their language's order from one range
partitioning. Blocks of 2**LEVELS consecutive digests are then reduced, each in its own task, to the node above
them, and again until no more than TOP nodes are left. The driver builds the tree of those and broadcasts, for each,
the path from there to the root: TOP paths at most, whatever the table's size. Executors build each block's tree
again, put its rows' paths before the broadcast one, and fold every row to the root.

With more than 2**LEVELS * TOP rows there are further rounds of blocks; their paths come down as tables, a join a
round, since only the uppermost is bounded. More than TOP languages are a sequence that is reduced in the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

#: A block has 2**LEVELS digests, some 300 bytes each.
LEVELS = 12
#: Nodes that the driver takes at most: their paths, of some 60 digests at most, are what is broadcast.
TOP = 4096
#: Rows whose tampering is tried: those whose id has a CRC-32 that this divides.
EVERY = 7
_NODE = "key string, pos long, total long, hash string"
_PATH = "key string, pos long, steps array<string>, subroot string"


def _sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value that no other value, and no list of others, is written like: its byte count, a colon, itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(n_chars: Column) -> Column:
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang")]
    return F.sha2(F.concat(*fields, field(n_chars), field(F.col("text"))).cast("binary"), 256)


def leaves(documents: DataFrame, every: int = EVERY) -> DataFrame:
    """documents -> (key, doc_id, hash, tampered, tie). key is the language, null's sorting first. tampered is the
    digest of the row with one more character counted, null where the row is left alone or has no count."""
    tried = F.col("n_chars").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    # Equal rows have equal digests: which of them comes first makes no difference but to the order itself.
    return documents.select(key.alias("key"), "doc_id", _leaf(F.col("n_chars")).alias("hash"), F.when(tried, _leaf(F.col("n_chars") + 1)).alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def numbered(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, their place by order among the rows of their key, from 0, and total, how many those are.

    Rows are dealt by ranges of order and sorted there, so a key of any size spreads over many tasks. What lies before
    a range is summed over one row a range and key."""
    dealt = rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    # The id counts up within a partition, and its upper bits number the partitions in their order.
    placed = scratch.save(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by_key = Window.partitionBy("key")
    before = F.sum("_n").over(by_key.orderBy("_part")) - F.col("_n")
    runs = runs.select("key", "_part", (F.col("_first") - before).alias("_zero"), F.sum("_n").over(by_key).alias("total"))
    return placed.join(runs, ["key", "_part"]).withColumn("pos", F.col("_at") - F.col("_zero")).drop("_at", "_part", "_zero")


def tree(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels over nodes, the nodes first: so many levels more, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def steps_from(levels: list[list[str]], i: int) -> list[str]:
    """The way from node i to the top: for each level the side and digest of its sibling, or - if it has none."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(("L" if j < i else "R") + level[j] if j < len(level) else "-")
        i >>= 1
    return out


def fold(digest: str, steps: list[str]) -> str:
    """The root that a digest leads to along its steps."""
    for step in steps:
        digest = _sha(step[1:], digest) if step[0] == "L" else _sha(digest, step[1:])
    return digest


def _block_tree(rows: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    """A block's rows in order, and its tree: one node is left if it is its key's only block, else `levels` levels."""
    rows = rows.sort_by("pos")
    alone = rows.column("total")[0].as_py() <= 1 << levels
    return rows, tree(rows.column("hash").to_pylist(), None if alone else levels)


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """Each block's upper node, numbered by the block."""

    def run(rows: pa.Table) -> pa.Table:
        rows, built = _block_tree(rows, levels)
        key, pos, total = (rows.column(c)[0].as_py() for c in ("key", "pos", "total"))
        return pa.table({"key": [key], "pos": [pos >> levels], "total": [-(-total >> levels)], "hash": built[-1]})

    blocks = nodes.select("key", "pos", "total", "hash", F.shiftright("pos", levels).alias("block"))
    return blocks.groupBy("key", "block").applyInArrow(run, _NODE)


def _upper(rows: list, merged: bool) -> tuple[dict, str]:
    """Of the driver's nodes {(key, pos): (steps, subroot)}, and the root."""
    keys: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["pos"])):
        keys.setdefault(r["key"], []).append(r["hash"])
    trees = {key: tree(nodes) for key, nodes in keys.items()}
    if merged:
        (only,) = trees.values()
        return {("", i): (steps_from(only, i), None) for i in range(len(only[0]))}, only[-1][0]
    above = tree([t[-1][0] for t in trees.values()])
    paths = {}
    for k, (key, built) in enumerate(trees.items()):
        over = steps_from(above, k)
        paths |= {(key, i): (steps_from(built, i) + over, built[-1][0]) for i in range(len(built[0]))}
    return paths, above[-1][0]


def _down(nodes: DataFrame, levels: int, above, work, schema: str) -> DataFrame:
    """work(rows of a block, its tree, steps above it, subroot) for every block. above is a broadcast of the steps, or a
    table of them where they are too many for that."""
    blocks = nodes.withColumn("block", F.shiftright("pos", levels)).groupBy("key", "block")
    if not isinstance(above, DataFrame):

        def run(rows: pa.Table) -> pa.Table:
            key = (rows.column("key")[0].as_py(), rows.column("block")[0].as_py())
            return work(*_block_tree(rows, levels), *above.value[key])

        return blocks.applyInArrow(run, schema)

    def met(rows: pa.Table, path: pa.Table) -> pa.Table:
        return work(*_block_tree(rows, levels), path.column("steps")[0].as_py(), path.column("subroot")[0].as_py())

    return blocks.cogroup(above.groupBy("key", "pos")).applyInArrow(met, schema)


def _paths(rows: pa.Table, built: list[list[str]], over: list[str], subroot: str | None) -> pa.Table:
    steps = [steps_from(built, i) + over for i in range(rows.num_rows)]
    return pa.table([rows.column("key"), rows.column("pos"), pa.array(steps, pa.list_(pa.string())), pa.array([subroot] * rows.num_rows, pa.string())], ["key", "pos", "steps", "subroot"])


def manifest(documents: DataFrame, levels: int = LEVELS, top: int = TOP, every: int = EVERY) -> DataFrame:
    """documents (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified), a row for each row.

    A language's rows ascend by doc_id, null first, then by digest; equal rows are neighbours, each with its own proof.
    A null column is told from every value, the language null is one of its own, and a row without doc_id is never
    tampered with. Texts are hashed whole. Other columns, whatever their names, are ignored; an empty table gives an
    empty one. levels is 1 at least, top 2 at least."""
    if levels < 1 or top < 2:
        raise ValueError("levels must be 1 at least and top 2")
    scratch = Scratch(documents.sparkSession, "merkle")
    rows = scratch.save(leaves(documents, every), "leaves")
    nodes = numbered(scratch, rows, ["key", "doc_id", "hash", "tie"], "ordered")
    rounds, merged = [nodes], None
    while True:
        nodes = scratch.save(_reduced(nodes, levels), f"nodes-{len(rounds)}")
        if nodes.count() <= top:
            break
        if merged is None and nodes.where("total > 1").isEmpty():
            nodes = numbered(scratch, nodes.select(F.lit("").alias("key"), F.col("key").alias("name"), "hash"), ["name"], "subroots")
            merged = len(rounds)
        rounds.append(nodes)
    upper, root = _upper(found, merged is not None) if (found := nodes.collect()) else ({}, "")
    above = documents.sparkSession.sparkContext.broadcast(upper)
    for i in range(len(rounds) - 1, 0, -1):
        above = scratch.save(_down(rounds[i], levels, above, _paths, _PATH), f"paths-{i}")
        if i == merged:
            named = rounds[i].select("pos", F.col("name").alias("key"), F.col("hash").alias("subroot"))
            above = above.drop("key", "subroot").join(named, "pos").select("key", F.lit(0).cast("long").alias("pos"), "steps", "subroot")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def finish(rows: pa.Table, built: list[list[str]], over: list[str], subroot: str) -> pa.Table:
        tops: dict[str, str] = {}
        proofs, folded = [], []
        tail = "".join(s[1:] for s in over)
        for i, (leaf, tampered) in enumerate(zip(rows.column("hash").to_pylist(), rows.column("tampered").to_pylist(), strict=True)):
            steps = steps_from(built, i)
            proofs.append(_sha(*(s[1:] for s in steps), tail))
            block = fold(tampered or leaf, steps)
            if block not in tops:
                tops[block] = fold(block, over)
            folded.append(tops[block])
        n = rows.num_rows
        return pa.table([rows.column("doc_id"), rows.column("hash"), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _down(rounds[0], levels, above, finish, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
