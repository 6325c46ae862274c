"""Connected components of a link table, and of the links that candidate lists hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch


def _stars(batches):
    """Task side: a task's links as links of each of their ids with the least one that it reaches by them."""
    u, v = [], []
    for b in batches:
        u.append(b.column("u").to_numpy())
        v.append(b.column("v").to_numpy())
    if not u:
        return
    ids, at = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    i, j = at[: len(at) // 2], at[len(at) // 2 :]
    least = np.arange(len(ids))
    while (least[i] != least[j]).any():
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, least[i], low)
        np.minimum.at(least, least[j], low)
        while (least[least] != least).any():
            least = least[least]
    some = np.flatnonzero(least != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[least[some]])], ["u", "v"])


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """links (u, v) -> (id, component): every linked id with the smallest id that it can reach.

    Alternating large-star and small-star rounds: each links every node to the smallest of its neighbours,
    first with its larger, then with its smaller neighbours. Minima are combined before the shuffle and joined
    back, so a hub of any degree is a skewed join that adaptive execution splits, not one task's group. Ids
    without a link, links to oneself and nulls have no row here. Raises if it has not settled after `rounds`.
    Before and after each round every task makes stars of its own links, so that few rounds are needed.
    """
    ends = "u long, v long"
    edges = links.where("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = edges.distinct().mapInArrow(_stars, ends)
    state = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")]
    edges, seen = scratch.save_with(edges, f"{name}-0", state)
    for i in range(1, rounds + 1):
        if not seen["n"]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct().mapInArrow(_stars, ends)
        edges, now = scratch.save_with(small, f"{name}-{i}", state)
        scratch.drop(f"{name}-{i - 1}")
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components have not settled after {rounds} rounds")


#: Candidates of a list that meet in one block, on average, before lists that are still open are paired in full.
BLOCK = 32


def merged(table: DataFrame, moved: DataFrame | None, column: str = "component") -> DataFrame:
    """table with the components of `column` replaced by those that they are now part of."""
    if moved is None:
        return table
    now = moved.select(F.col("id").alias(column), F.col("component").alias("_now"))
    return table.join(now, column, "left").withColumn(column, F.coalesce("_now", column)).select(*table.columns)


def distinct_lists(entries: DataFrame) -> DataFrame:
    """entries (key, doc_id, pos) of lists of several candidates, and of lists of the same candidates only one: that
    of the least place, which all their pairs meet first. Lists are told apart by their size and 128 bits of
    hashes. If entries have sizes n, each is given the least one of its list."""
    entries = entries.where("key is not null")  # as the join below asks for, so that both uses read one shuffle
    sized = "n" in entries.columns
    lists = entries.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size"), F.min("pos").alias("pos"), F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("h2"), *([F.min("n").alias("least")] if sized else [])).where("lo < hi")
    keys = lists.groupBy("size", "lo", "hi", "h1", "h2").agg(F.min(F.struct("pos", "key"))["key"].alias("key"), *([F.min("least").alias("least")] if sized else []))
    return entries.join(keys.select("key", "least"), "key") if sized else entries.join(keys.select("key"), "key", "left_semi")


def _ends() -> list[Column]:
    return [F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")]


def fitting(n_u: str, pos_u: str, n_v: str, pos_v: str, percent: int) -> Column:
    """Whether two sets' sizes, and how many of their elements cannot be shared, leave room for a link."""
    return F.expr(f"100 * least({n_u}, {n_v}) >= {percent} * greatest({n_u}, {n_v}) and least({n_u} - {pos_u}, {n_v} - {pos_v}) * {100 + percent} >= {percent} * ({n_u} + {n_v})")


def fitting_alone(percent: int) -> Column:
    """Whether a set (n, pos) may link with one of at least `least` elements: fitting, of the smallest that can."""
    return F.expr(f"(bigint(n) - pos) * {100 + percent} >= {percent} * (n + greatest(bigint(least), ({percent} * bigint(n) + 99) div 100))")


def bitmaps_fit(percent: int) -> Column:
    """Of two sets with bitmaps (words, and `set`, the number of their bits), whether these leave room for a link: each
    bit that only one of them has stands for an element at least that the other lacks. What only y has follows from
    what only x has. Exact, whatever the bitmaps' size."""
    return F.expr(f"""
exists(array(int(aggregate(zip_with(words_x, words_y, (a, b) -> bit_count(a & ~b)), 0, (s, c) -> s + c))),
       o -> least(n_x - o, n_y - o + set_x - set_y) * {100 + percent} >= {percent} * (n_x + n_y))""")


def settle(entries: DataFrame, verified: Callable[[DataFrame, int], DataFrame], percent: int, scratch: Scratch, detail: Callable[[DataFrame], DataFrame] | None = None, fits: Column | None = None) -> DataFrame | None:
    """(id, component) of the components that links in the lists join; None if there is no link. A component
    that is not named stays as it is.

    entries (key, doc_id, n, pos, rank, component): a list a key, of candidates with their set's size, how many
    of their elements cannot be in an overlap that this list finds, and the component that each has so far;
    rank is least where most links are to be expected. verified: of pairs (u, v, cu, cv) those that link, as a
    saved table. First every candidate meets its list's anchor. Then lists are dealt by hash into blocks of BLOCK
    candidates and those of one block meet: so many times the list's length of pairs, in as many groups as it has
    blocks, and all pairs of a list that is one block. Groups whose members link with few others each, of which
    no anchor finds many, are thus of few components before the last round pairs candidates of different
    components and blocks. A pair is made unless sizes, places or `fits` rule a link out: a condition on what
    `detail` gives of each doc_id, as columns with _x and _y. So no link between components is missed, a list of
    one component costs nothing more, and a group of copies costs a pair a copy. A list of two that have met is done.
    """
    met = moved = None
    held = entries
    span = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    anchor = F.min_by(F.struct("doc_id", "n", "pos", "component"), F.struct("rank", F.hash("doc_id"), "doc_id")).alias("a")
    least, size = F.min("n").alias("least"), F.count(F.lit(1)).alias("size")
    more = [[size, anchor], [least, size, F.min("doc_id").alias("u"), F.max("doc_id").alias("v")], [least]]
    for i in range(3):
        bounds = held.groupBy("key").agg(*span, *more[i]).where("lo < hi")
        if not i:
            anchors = bounds.select("key", "a.*").toDF("key", "v", "n_v", "pos_v", "cv")
            pairs = held.join(anchors, "key").where((F.col("component") != F.col("cv")) & fitting("n", "pos", "n_v", "pos_v", percent))
            pairs = pairs.groupBy(F.col("doc_id").alias("u"), "v").agg(F.count("*").alias("shared"), F.min("component").alias("cu"), F.min("cv").alias("cv"))
            pairs = pairs.groupBy("u").agg(F.max_by(F.struct("v", "cu", "cv"), F.struct("shared", "v")).alias("p")).select("u", "p.*")
        else:
            # Lists of one component have nothing left to find; those of one block have all met by the second round.
            if i == 1:
                bounds = bounds.join(met.select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(2).cast("long").alias("size")), ["u", "v", "size"], "left_anti")
            held = held.join(bounds.select("key", "least"), "key")
            held = scratch.save(held if i == 1 else held.where("blocks > 1"), f"open-{i}")
            if held.isEmpty():
                break
            # Sets that fit none of their list's sizes meet nobody there, and so may all its others but those of one component.
            both, held = held.where(fitting_alone(percent)).drop("least"), held.drop("least")
            both = scratch.save(both.join(both.groupBy("key").agg(*span).where("lo < hi").select("key"), "key", "left_semi"), f"fitting-{i}")
            both = both if detail is None else both.join(detail(both.select("doc_id").distinct()), "doc_id")
            on = ["key", "block"][: 3 - i]
            x, y = (both.select(*on, *(F.col(c).alias(f"{c}_{s}") for c in both.columns if c not in on)) for s in "xy")
            room = (F.col("component_x") < F.col("component_y")) & fitting("n_x", "pos_x", "n_y", "pos_y", percent)
            room = room if i == 1 else room & (F.col("block_x") != F.col("block_y"))
            pairs = x.join(y, on).where(room if fits is None else room & fits)
            pairs = pairs.select(F.col("doc_id_x").alias("u"), F.col("doc_id_y").alias("v"), F.col("component_x").alias("cu"), F.col("component_y").alias("cv")).distinct()
            pairs = pairs.select("*", *_ends()).join(met, ["lo", "hi"], "left_anti").drop("lo", "hi")
        pairs, counted = scratch.save_with(pairs, f"chosen-{i}", [F.count(F.lit(1)).alias("n")])
        now = None
        if counted["n"]:
            now = components(verified(pairs, i).select(F.col("cu").alias("u"), F.col("cv").alias("v")), scratch, f"round-{i}")
            # Links are between components as they were before this round, so what moved then moves on with them.
            moved = now if moved is None else scratch.save(merged(moved, now).union(now.join(moved, "id", "left_anti")), f"moved-{i}")
        if i < 2:
            ends = pairs.select(*_ends())
            met = ends if met is None else met.union(ends)
            if not i:
                dealt = bounds.select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
                held = held.join(dealt, "key").select("key", "doc_id", "n", "pos", "component", "blocks", F.pmod(F.xxhash64("doc_id", "key"), "blocks").alias("block"))
            held = scratch.save(merged(held, now), f"held-{i}")
        scratch.release()
    scratch.drop("open-1", "open-2", "fitting-1", "fitting-2", "held-0", "held-1")
    return moved
