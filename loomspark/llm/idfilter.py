"""A filter of wanted ids with a size that does not depend on the data: one bit an id, 16 MB at most.

It is broadcast so that rows nobody wants are dropped where they are read. Chance hits pass and must be
removed by an exact join; with very many wanted ids everything passes, and only that join is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << BITS)).alias("bit")


def id_filter(ids: DataFrame, column: str = "doc_id"):
    """A broadcast of the bits of all ids, and the column that is a row's place there."""
    bit = id_bit(column) + 1
    blocks = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for block, got in blocks.collect():  # 4096 blocks of 4 KB at most
        bits[(block - 1) * 4096 : block * 4096] = np.frombuffer(got, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits), id_bit(column)


def hits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def wanted_rows(rows: DataFrame, ids: DataFrame):
    """rows with `bit`, and a task side filter of batches to those of the ids, and chance hits, with its broadcast."""
    shared, bit = id_filter(ids)

    def only(batches):
        for b in batches:
            yield b.filter(pa.array(hits(shared.value, b.column("bit").to_numpy(zero_copy_only=False))))

    return rows.select("*", bit), only, shared


def xxhash_bits(ids: np.ndarray) -> np.ndarray:
    """id_bit of 64-bit integers outside Spark: xxHash64 of their eight bytes with seed 42."""
    u = np.uint64
    # Fixed values of xxHash64.
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def left(x, n):
        return (x << u(n)) | (x >> u(64 - n))

    h = (left(ids.view(u) * p2, 31) * p1) ^ (u(42) + p5 + u(8))
    h = left(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return ((h ^ (h >> u(32))) & u((1 << BITS) - 1)).astype(np.int64)
