"""Exact deduplication behind a two-pass Bloom filter, in built-in functions only.

Pass one counts the bits that the texts' hashes set and keeps, as a blocked Bloom filter, those set more
than once. Pass two tests every row: a row with a bit that no other row set is certainly unique and passes
straight through; only the others shuffle, to be compared by their whole SHA-256.

The filter has 2**bits bits in blocks of 32768, two bits a row, both in one block. It is broadcast, and its
size is bounded by that parameter alone: 16 MB at most. With many more rows than 2**bits / 16 it lets more
unique rows shuffle; results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

BITS = 27
_BLOCK = 32768


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _places(sha: Column, bits: int) -> tuple[Column, Column, Column]:
    """The block of a hash and its two bits there."""
    wide = F.xxhash64(sha)
    blocks = (1 << bits) // _BLOCK
    return F.pmod(wide, F.lit(blocks)), F.pmod(F.shiftrightunsigned(wide, 20), F.lit(_BLOCK)), F.pmod(F.shiftrightunsigned(wide, 40), F.lit(_BLOCK))


def repeat_filter(hashes: DataFrame, sha: str = "sha", bits: int = BITS, least: int = 2) -> DataFrame:
    """(block, twice): for each block in use a bitmap of the bits that at least `least` rows set.

    Rows are counted bit by bit with map-side sums, so a hash that a third of all rows share sends one
    row a task. A block has 4 KB; there are 2**bits / 32768 at most."""
    block, one, two = _places(F.col(sha), bits)
    set_bits = hashes.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    twice = set_bits.groupBy("block", "bit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("twice"))


def flag_repeats(rows: DataFrame, filters: DataFrame, sha: str = "sha", bits: int = BITS) -> DataFrame:
    """rows with `maybe`: false where no other row can have the same hash."""
    block, one, two = _places(F.col(sha), bits)

    def isset(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("twice", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1

    held = rows.withColumn("_block", block).join(F.broadcast(filters.withColumnRenamed("block", "_block")), "_block", "left")
    return held.withColumn("maybe", F.coalesce(isset(one) & isset(two), F.lit(False))).drop("_block", "twice")


def groups_of(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, sha) -> (doc_id, sha, keep_id, group_size), a row for each row."""
    flagged = flag_repeats(hashes, repeat_filter(hashes, bits=bits), bits=bits)
    alone = flagged.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    some = flagged.where("maybe").select("doc_id", "sha")
    kept = some.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return alone.unionByName(some.join(kept, "sha"))


def duplicate_groups(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256), a row for each row.

    Texts are equal when they are after white-space runs become one space; null counts as empty. Of equal
    texts the row with the smallest doc_id stays; a null doc_id is larger than any other, and with only
    nulls in a group keep_id is null and each of them is kept. Rows that repeat an id and a text are all
    marked kept or all not (keep_rows leaves one of them). Other columns are ignored.
    """
    # Written once: both passes and the comparison read hashes, and each text is read and hashed once.
    scratch = Scratch(documents.sparkSession, "exact")
    hashes = scratch.save(documents.select("doc_id", digest(F.col("text")).alias("sha")), "hashes")
    return groups_of(hashes, bits).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_rows(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows that stay, whole: unique rows go straight from the scan to the result.

    Only rows that may have an equal shuffle with their texts. Of rows that repeat both id and text one
    stays. Columns of any name and number pass through."""
    taken = {c.lower() for c in documents.columns}
    sha = next(f"sha_{i}" for i in range(1000) if f"sha_{i}" not in taken)
    names = {c: f"{sha}_{i}" for i, c in enumerate(documents.columns)}  # so that no column clashes with ours
    inner = documents.select(*(F.col(f"`{c}`").alias(names[c]) for c in documents.columns))
    low = {c.lower(): x for c, x in names.items()}
    doc_id, text = low["doc_id"], low["text"]
    inner = inner.withColumn("sha", digest(F.col(text)))
    flagged = flag_repeats(inner, repeat_filter(inner.select("sha"), bits=bits), bits=bits)
    alone, some = flagged.where("not maybe"), flagged.where("maybe")
    kept = some.groupBy("sha").agg(F.min(doc_id).alias("keep_id"))
    same = (F.col("kept_sha") == F.col("sha")) & F.col(doc_id).eqNullSafe(F.col("keep_id"))
    stays = some.join(kept.withColumnRenamed("sha", "kept_sha"), same, "left_semi").dropDuplicates([doc_id, "sha"])
    both = alone.select(*names.values()).unionByName(stays.select(*names.values()))
    return both.select(*(F.col(x).alias(c) for c, x in names.items()))
