"""Sharding by a permutation-filled lookup table, in built-in functions only.

Every shard has its own order of preference over the slots of a prime-sized table, (offset + j * skip) mod
size. The shards take turns; each claims its next slot that is still free, until the table is full. Shards so
get equal shares of slots, and when one leaves few slots change hands among the others.

The table has a fixed size (65537 slots, two bytes each), whatever the data's; placing a row is one lookup
in its broadcast copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and large beside the number of shards: shares differ by at most one slot.
TABLE_SIZE = 65537
MAX_SHARDS = 4096


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claims it."""
    if not 0 < len(shards) <= min(MAX_SHARDS, size) or len(set(shards)) != len(shards):
        raise ValueError(f"1 to {min(MAX_SHARDS, size)} different shards are needed")
    if size < 2 or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime number")
    offset, skip = [], []
    for name in shards:
        words = hashlib.sha256(name.encode()).digest()
        offset.append(int.from_bytes(words[:8], "big") % size)
        skip.append(int.from_bytes(words[8:16], "big") % (size - 1) + 1)
    table, at, left = [-1] * size, list(offset), size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5 modulo the size. Null has the empty string's."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(size))


def lookup(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard_id, shard), one row a slot."""
    cells = F.lit(b"".join(i.to_bytes(2, "big") for i in fill_table(shards, size)))
    names = F.array(*(F.lit(x) for x in shards))
    cell = F.substring(cells, (F.col("id") * 2 + 1).cast("int"), F.lit(2))
    out = spark.range(0, size, 1, 1).select(F.col("id").alias("slot"), F.conv(F.hex(cell), 16, 10).cast("int").alias("shard_id"))
    return out.withColumn("shard", F.element_at(names, F.col("shard_id") + 1))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """rows with slot, shard_id and shard. No row moves: the table (size rows) is broadcast.

    Equal keys, nulls among them, get equal shards; an empty table gives an empty one. A column of rows that is
    named slot, shard_id or shard, the key among them, stays, with underscores added to its name."""
    taken, names = {c.lower() for c in rows.columns} | {"slot", "shard_id", "shard"}, []
    for c in rows.columns:
        name = c
        while name.lower() in ("slot", "shard_id", "shard") or (name != c and name.lower() in taken):
            name += "_"
        taken.add(name.lower())
        names.append(name)
    slot = slot_of(F.col(f"`{key}`"), size)
    held = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)), slot.alias("slot"))
    return held.join(F.broadcast(lookup(rows.sparkSession, shards, size)), "slot")


def moved(rows: DataFrame, key: str, before: Sequence[str], after: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Rows whose shard differs between two lists of shards: what a resize has to copy."""
    old = lookup(rows.sparkSession, before, size).select("slot", F.col("shard").alias("old_shard"))
    return place(rows, key, after, size).join(F.broadcast(old), "slot").where("shard != old_shard")
