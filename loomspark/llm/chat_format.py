"""Chat formatting of reply trees, in built-in functions only.

Messages form trees by parent. Jump tables, each joined with itself, reach the ancestors 1, 2, 4, ... steps
up, so a tree of depth d is walked in log2(d) rounds of joins; a round keeps only messages that still have
an ancestor so far up. Leaves are ranked by their branch's score, and the chosen leaves' paths come out of
the same jump tables, root to leaf. Each path is formatted as one conversation.

The template puts control marks in angle brackets round every turn. Inside roles and texts the characters
``& < [`` (and line feeds in roles) are written as entities, so neither the template's own marks nor others'
(``</s>``, ``[INST]``, ``<|im_end|>``) can occur there, and reading back restores every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

START, END = "<turn>", "</turn>"
#: In the order in which they are written; reading back undoes them in reverse.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def chain_messages(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees of one branch: each row replies to the one before.

    Rows of a conversation are ordered by turn, then role and text, nulls first, so ties and repeated rows
    have a defined place. Null roles and texts count as empty; rows with a null conv_id are one
    conversation. A conversation becomes one string in the end, so its rows may meet in one task."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role, text)
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", at.alias("msg_id"), "role", "text").withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn("score", F.lit(0.0))


def chosen_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """messages (conv_id, msg_id, parent_id, score, ..) -> (conv_id, branch, position, msg_id).

    branch numbers a conversation's kept leaves from 1 by the mean score of their path, highest first, then
    by length, longest first, then msg_id. position counts from the root. A parent that is null or missing
    makes a root. (conv_id, msg_id) must be unique (`once` makes it so); a cycle of parents raises ValueError. A
    null score counts as 0."""
    key = lambda df: df.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    nodes = scratch.save(key(messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))), "nodes")
    links = nodes.where("parent_id is not null").select("tree", "msg_id", F.col("parent_id").alias("up"))
    known = nodes.select("tree", F.col("msg_id").alias("up"), F.col("score").alias("gain"))
    # jumps[i]: the ancestor 2**i steps up, and the scores on the way to it, its own included.
    jumps = [scratch.save(links.join(known, ["tree", "up"]).select("tree", "msg_id", "up", "gain"), "jump-0")]
    size = nodes.count()
    while True:
        last = jumps[-1]
        further = last.alias("a").join(last.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.msg_id")))
        further = scratch.save(further.select("a.tree", "a.msg_id", "b.up", (F.col("a.gain") + F.col("b.gain")).alias("gain")), f"jump-{len(jumps)}")
        if further.isEmpty():
            break
        if 1 << len(jumps) > size:  # no path is that long
            raise ValueError("parents form a cycle")
        jumps.append(further)
    # Each leaf climbs by the longest jumps first: its depth and its path's score.
    parents = jumps[0].select("tree", F.col("up").alias("msg_id")).distinct()
    climb = nodes.join(parents, ["tree", "msg_id"], "left_anti").select("tree", F.col("msg_id").alias("leaf"), F.col("msg_id").alias("at"), "score", F.lit(0).cast("long").alias("depth"))
    for i in range(len(jumps) - 1, -1, -1):
        step = jumps[i].select("tree", F.col("msg_id").alias("at"), "up", "gain")
        climb = climb.join(step, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << i)).alias("depth"))
    order = [F.desc(F.col("score") / (F.col("depth") + 1)), F.desc("depth"), F.asc("leaf")]
    best = climb.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= branches)
    paths = scratch.save(best.select("tree", "branch", F.col("leaf").alias("msg_id"), F.col("depth").alias("position")), "leaves")
    # From the leaves up: a round adds the ancestors 2**i steps above all that is there.
    for i, jump in enumerate(jumps):
        more = paths.join(jump.select("tree", "msg_id", "up"), ["tree", "msg_id"]).select("tree", "branch", F.col("up").alias("msg_id"), (F.col("position") - (1 << i)).alias("position"))
        paths = scratch.save(paths.unionByName(more), f"path-{i}")
    return paths.join(nodes.select("tree", "msg_id", "conv_id"), ["tree", "msg_id"]).select("conv_id", "tree", "branch", "position", "msg_id")


def once(messages: DataFrame) -> DataFrame:
    """One row for each (conv_id, msg_id): of several the least by parent, role, text and score, nulls first."""
    row = F.struct("parent_id", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("score").cast("double").alias("score"))
    return messages.groupBy("conv_id", "msg_id").agg(F.min(row).alias("m")).select("conv_id", "msg_id", "m.*")


def format_messages(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """messages (conv_id, msg_id, parent_id, role, text, score) -> (conv_id, branch, formatted, loss_mask).

    loss_mask is array<struct<start, length>> over formatted, in code points: the escaped texts of the
    assistant's turns. Null roles and texts count as empty. An empty table gives an empty one; further
    columns are ignored. Rows that repeat a (conv_id, msg_id) count once; unique says that there are none. Messages
    are written once, as both the tree and the texts come from them."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.save(messages if unique else once(messages), "messages")
    paths = chosen_paths(messages, scratch, branches)
    role = F.replace(escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    text = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    said = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("tree"), "msg_id", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("learn"))
    turns = paths.join(said, ["tree", "msg_id"]).groupBy("tree", "branch").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("position", "head", "body", F.coalesce("learn", F.lit(False)).alias("learn")))).alias("turns"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        start, length = acc["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select("conv_id", "branch", whole.alias("formatted"), F.aggregate("turns", begin, step, lambda acc: acc["mask"]).alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, START, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        body = F.substr(x, cut + 1, F.length(x) - cut - len(END))
        return F.struct(unescape(F.replace(F.substr(x, F.lit(1), cut - 1), F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
