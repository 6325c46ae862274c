"""Jaccard self-join on word n-grams: a size-aware heavy-light join.

Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` over their sets of word n-grams.

1. *Sets.* Each text's n-grams are hashed and put into one global order: hash order, but with the most
   common n-grams last. Any order gives the same links; this one keeps shared passages out of prefixes.
   Documents with equal sets are one class from here on, stood for by their smallest id.
2. *Light.* A set of size s up to the boundary has every two-element subset of its prefix enumerated as
   a key. A partner must share at least c(s) = ceil(percent * s / 100) elements, so two partners share at
   least two elements of their first s - c(s) + 2 in the global order, hence a key.
3. *Heavy.* Larger sets, and light ones close enough to the boundary to have a heavy partner, enter the
   inverted lists of the first s - c(s) + 1 elements. Before that a bitmap of all elements in a fixed part of
   the hash range shows which of them no other set has; a set with more than s - c(s) such elements has no
   partner and enters no list. Of the sets that are left in lists the whole sets are then compared likewise: what none
   of the others has is in no overlap, and a set of too few others has no partner.
4. The boundary is where the modelled cost is least: subsets made against list entries scanned.
5. *Lists.* Within a list of one key, candidates are first paired with one anchor each, verified exactly, and
   merged into components; then those of one block of the list with one another, and last those of different
   components, under exact bounds by their sizes, by positions and by bitmaps of the sets, and verified. A group
   of thousands of near copies thus costs one verified pair a copy and not one for each pair of copies.

Verification intersects whole 64-bit n-gram sets. Hash collisions aside (about 2**-64 a pair of n-grams)
the result is exact: no list, set or group is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import batch
from loomspark.llm.components import bitmaps_fit, components, distinct_lists, fitting_alone, merged, settle
from loomspark.llm.idfilter import hits, id_filter, wanted_rows
from loomspark.llm.repeats import may_repeat, repeated
from loomspark.llm.store import Scratch

#: N-grams that are put last in the order: at most so many (a broadcast of 16 bytes each).
COMMON = 1 << 16
#: An n-gram is noted as common by a task if so many of some thousand consecutive documents have it.
LOCAL_COMMON = 3
_NOTE = 1 << 21

#: Elements whose hashes are in the lowest part of all are marked for every set, if they are not common ones:
#: those that no other set has prove how much of a set is its own.
WINDOW = 0.25

_SETS = "doc_id long, n int, fp1 long, fp2 long, window int, prefix binary"
_KEYS = "key long, doc_id long, n int, pos int"
_PAIR = ["u", "v", "cu", "cv"]
PAIRS = "u long, v long, cu long, cv long"


def least_overlap(n, percent: int):
    """c(n): what a set of n elements shares with any partner, at least."""
    return (n * percent + 99) // 100


def _sets_of(column: pa.Array, k: int) -> Iterator[tuple[batch.Chunk, np.ndarray, np.ndarray]]:
    for chunk in batch.chunks(column):
        values, per_row = batch.row_sets(*batch.shingles(batch.words_of(chunk, lower=True), k, whole_if_short=True))
        yield chunk, values, per_row


def _note_common(k: int):
    """Task side: n-grams that several of some thousand consecutive documents have, with how many."""

    def run(batches):
        kept, size = [], 0

        def told():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            often = counts >= LOCAL_COMMON
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["gram", "n"])

        for b in batches:
            for _, values, _ in _sets_of(b.column("text"), k):
                kept.append(values)
                size += len(values)
                if size >= _NOTE:
                    yield told()
                    kept, size = [], 0
        if size:
            yield told()

    return run


def _rank(values: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """0 for other values; from 1 on, the rarer first, for common ones."""
    if not len(common):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    return np.where(common[at] == values, ranks[at], 0)


def _make_sets(k: int, percent: int, shared):
    """Task side: size, two fingerprints of the set, and its first elements in the global order."""

    def run(batches):
        common, ranks = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for chunk, values, n in _sets_of(b.column("text"), k):
                row = np.repeat(np.arange(chunk.rows), n)
                last = _rank(values, common, ranks)
                if last.any():
                    touched = np.zeros(chunk.rows, bool)
                    touched[row[last > 0]] = True
                    bounds = np.concatenate(([0], np.cumsum(n)))
                    for r in np.flatnonzero(touched).tolist():
                        part = slice(bounds[r], bounds[r + 1])
                        turn = np.argsort(last[part], kind="stable")
                        values[part], last[part] = values[part][turn], last[part][turn]
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(batch.mix(values ^ np.uint64(salt))))) for salt in (0x51ED27, 0xC2B2AE3D27)]
                bounds = np.concatenate(([0], np.cumsum(n)))
                fp1, fp2 = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                low = (last == 0) & (values < np.uint64(int(WINDOW * 2**64)))
                window = np.bincount(row[low], minlength=chunk.rows)
                length = np.minimum(n, np.maximum(n - least_overlap(n, percent) + 2, window))
                inside = np.arange(len(values)) - np.repeat(bounds[:-1], n) < np.repeat(length, n)
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first, chunk.rows), pa.array(n.astype(np.int32)), pa.array(fp1), pa.array(fp2), pa.array(window.astype(np.int32)), batch.binaries(values[inside], length)], ["doc_id", "n", "fp1", "fp2", "window", "prefix"])

    return run


def _keys_of(b: pa.RecordBatch, percent: int, boundary: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, size, keys, places of their first element) of each set, by its size: subsets of two elements of
    the prefix, list entries of the prefix and the window, or both."""
    for row, (n, window, prefix) in enumerate(zip(b.column("n").to_pylist(), b.column("window").to_pylist(), b.column("prefix"), strict=True)):
        tokens = np.frombuffer(prefix.as_buffer(), "<u8")
        first = n - least_overlap(n, percent) + 1
        if n <= boundary and n > 1:
            i, j = np.triu_indices(first + 1, 1)
            yield row, n, batch.mix(tokens[i] * np.uint64(0x9FB21C651E98DF25) ^ batch.mix(tokens[j])), i
        if n * 100 > boundary * percent:
            length = max(first, window)
            yield row, n, batch.mix(tokens[:length]), np.arange(length)


def _make_keys(percent: int, boundary: int, shared):
    """Task side: the keys that more than one set may have. Sets over the boundary whose window proves that they
    have no partner have none; of others the window has done its part, and only the prefix is listed."""

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            rows, windows = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("window").to_pylist()
            for row, n, keys, pos in _keys_of(b, percent, boundary):
                some = np.flatnonzero(may_repeat(shared.value, keys))
                if n > boundary:
                    most = n - least_overlap(n, percent)
                    if windows[row] - int((some < windows[row]).sum()) > most:
                        continue
                    some = some[some <= most]
                for into, x in zip(out, (keys[some].view(np.int64), np.full(len(some), rows[row]), np.full(len(some), n, np.int32), pos[some].astype(np.int32)), strict=True):
                    into.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["key", "doc_id", "n", "pos"])

    return run


#: Sizes of which every list element is counted for the cost, and the share counted of larger ones.
SMALL, ONE_IN = 32, 16


def _boundary(reps: DataFrame, percent: int) -> int:
    """The size up to which sets are light, by the cost of either way over the whole table.

    List lengths are counted, of every element of sets of SMALL elements or fewer and of one in ONE_IN elements
    of larger ones; they decide the cost and never the result. The summary has at most as many rows as there are
    sizes up to 256; beyond, subsets of two always cost more than they save."""

    def sample(batches):
        for b in batches:
            n, per = b.column("n").to_numpy(zero_copy_only=False), [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("prefix")]
            per = [x[: s - least_overlap(s, percent) + 1] for x, s in zip(per, n.tolist(), strict=True)]
            lens = np.array([len(x) for x in per], np.int64)
            tokens, n = np.concatenate([*per, np.zeros(0, np.uint64)]), np.repeat(n, lens)
            some = (n <= SMALL) | (tokens % np.uint64(ONE_IN) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(n[some].astype(np.int32))], ["key", "n"])

    tokens = reps.select("n", "prefix").mapInArrow(sample, "key long, n int")
    lists = tokens.groupBy("key", F.least("n", F.lit(257)).alias("size")).agg(F.count("*").alias("c"))
    lists = lists.join(lists.groupBy("key").agg(F.sum("c").alias("length")), "key").groupBy("size").agg((F.sum(F.col("c") * (F.col("length") - 1)) / F.sum("c")).alias("scanned"))
    scanned = {r[0]: r[1] for r in lists.collect()}
    sizes = {r[0]: r[1] for r in reps.where("n <= 256").groupBy("n").agg(F.count("*")).collect()}
    return cheapest_boundary(sizes, scanned, percent)


def cheapest_boundary(sizes: dict[int, int], scanned: dict[int, float], percent: int) -> int:
    """The boundary of least cost, 0 if every set is heavy. sizes: sets by size; scanned: other entries in the
    list of an element, in the mean, by its set's size. A light set of prefix p costs its p (p + 1) / 2 subsets, a
    heavy one an entry and a scan of the list for each of p elements."""
    best, least, total = 0, 0.0, 0.0
    for s in range(1, 257):
        p = s - least_overlap(s, percent) + 1
        total += sizes.get(s, 0) * ((p + 1) * p / 2 - p * (1 + scanned.get(s, 0.0)))
        if total < least:
            best, least = s, total
    return best


def _bound(percent: int):
    """Task side: of pairs with both prefixes as order codes, those that may link.

    Below the lesser of the two last codes both sets are known, so what only one of them has there is in no
    overlap: an upper bound. Codes of different elements may be equal, which can only raise it."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y, s, t) in enumerate(zip(b.column("codes_u"), b.column("codes_v"), b.column("n_u").to_pylist(), b.column("n_v").to_pylist(), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                cut = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, cut)], y[: np.searchsorted(y, cut)]
                both = 0
                if len(x) and len(y):
                    both = max(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()), int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()))
                most = both + min(s - len(x), t - len(y))
                keep[i] = most * (100 + percent) >= percent * (s + t)
            yield b.filter(pa.array(keep)).select(_PAIR)

    return run


def verify(percent: int):
    """Task side: of pairs with both sets, those that link."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("set_u"), b.column("set_v"), strict=True)):
                keep[i] = jaccard_at_least(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent)
            yield b.filter(pa.array(keep)).select(_PAIR)

    return run


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets, not both empty, reach a similarity."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _pick(reps: DataFrame, ids: DataFrame, percent: int, shared, scratch: Scratch) -> DataFrame:
    """(doc_id, n, codes) of wanted ids, and chance hits, so that a join with those ids shuffles little else.

    Codes are the prefix's elements as 32-bit numbers in the global order, a third of its size: the first bits
    of the hash, or, above all those, a common element's rank."""
    wanted, bit = id_filter(ids)

    def run(batches):
        common, ranks = shared.value
        for b in batches:
            b = b.filter(pa.array(hits(wanted.value, b.column("bit").to_numpy(zero_copy_only=False))))
            codes = []
            for n, prefix in zip(b.column("n").to_pylist(), b.column("prefix"), strict=True):
                tokens = np.frombuffer(prefix.as_buffer(), "<u8")[: n - least_overlap(n, percent) + 2]
                rank = _rank(tokens, common, ranks)
                codes.append(np.where(rank > 0, rank + (1 << 31), (tokens >> np.uint64(33)).astype(np.int64)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(codes, pa.binary())], ["doc_id", "n", "codes"])

    some = scratch.save(reps.select("doc_id", "n", "prefix", bit).mapInArrow(run, "doc_id long, n int, codes binary"), "some")
    wanted.destroy()
    return some


#: 64-bit words of a set's bitmap.
WORDS = 32


def _partnered(docs: DataFrame, ids: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n, shared, set) of those of the ids that may have a partner: shared is how many of a set's n elements
    another of these sets has, at most so many more as meet by chance. A partner has at least c(n) of them, so sets
    that share less are left out. Every other use of whole sets reads this table, not the texts."""
    some, only, wanted = wanted_rows(docs, ids)
    met = repeated(some, lambda batches: ((values, None) for b in only(batches) for _, values, _ in _sets_of(b.column("text"), k)))

    def run(batches):
        for b in only(batches):
            for chunk, values, n in _sets_of(b.column("text"), k):
                shared = np.bincount(np.repeat(np.arange(chunk.rows), n)[may_repeat(met.value, values)], minlength=chunk.rows)
                keep = (shared >= least_overlap(n, percent)) & (n > 0)
                if keep.any():
                    rows = b.column("doc_id").slice(chunk.first, chunk.rows).filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([rows, pa.array(n[keep].astype(np.int32)), pa.array(shared[keep].astype(np.int32)), batch.binaries(values[np.repeat(keep, n)], n[keep])], ["doc_id", "n", "shared", "set"])

    whole = scratch.save(some.mapInArrow(run, "doc_id long, n int, shared int, set binary"), "whole")
    met.destroy()
    wanted.destroy()
    return whole


def _bitmaps(whole: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, words, set) of wanted ids, and chance hits: the bitmaps of whole sets."""
    some, only, wanted = wanted_rows(whole.select("doc_id", "set"), ids)

    def run(batches):
        for b in only(batches):
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("set")]
            if sets:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *batch.bitmaps(np.concatenate(sets), np.array([len(x) for x in sets]), WORDS)], ["doc_id", "words", "set"])

    made = scratch.save(some.mapInArrow(run, "doc_id long, words array<long>, set int"), "bitmaps")
    wanted.destroy()
    return made


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80, boundary: int | None = None) -> DataFrame:
    """documents (doc_id long, text) -> (doc_id, n_shingles long, component_id long), a row for each row.

    component_id is the smallest doc_id that a document reaches by links, itself included. A null text is
    an empty one; a text without words has an empty set and links with nothing. A text of fewer than k
    words has one n-gram, all its words. A-Z are lower-cased. Rows with a null doc_id get a null
    component and link with nothing. If a doc_id comes more than once, the links of all its texts
    count as its links. Other columns are ignored. boundary: the size up to which sets are light, chosen by
    cost if not given; the result is the same for any.
    """
    scratch = Scratch(documents.sparkSession, "ngram-join")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    noted = docs.select("text").mapInArrow(_note_common(k), "gram long, n long")
    top = noted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    grams = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(grams)
    common = docs.sparkSession.sparkContext.broadcast((grams[order], (len(grams) - np.arange(len(grams)))[order]))

    sets = scratch.save(docs.mapInArrow(_make_sets(k, percent, common), _SETS), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    # A set is a class; ids that come more than once tie their classes together.
    least = full.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    members = scratch.save(sets.select("doc_id", "n", "fp1", "fp2").join(least, ["n", "fp1", "fp2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component")), "members")
    # A document that is not its class's smallest id may pass by chance: its component is known, so it adds no pair.
    stand, bit = id_filter(members.where("n > 0 and doc_id = component").select("doc_id"))

    def standing(batches):
        for b in batches:
            b = b.filter(pa.array(hits(stand.value, b.column("bit").to_numpy(zero_copy_only=False))))
            yield b.select(["doc_id", "n", "fp1", "fp2", "window", "prefix"])

    reps = full.select("*", bit).mapInArrow(standing, _SETS)
    unique = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    if not unique:
        reps = reps.dropDuplicates(["doc_id", "n", "fp1", "fp2"])
    reps = scratch.save(reps.select("doc_id", "n", "window", "prefix"), "reps")
    stand.destroy()
    scratch.drop("sets")
    scratch.release()

    if boundary is None:
        boundary = _boundary(reps, percent)
    shared = repeated(reps.select("n", "window", "prefix"), lambda batches: ((keys, None) for b in batches for _, _, keys, _ in _keys_of(b, percent, boundary)))
    keys = scratch.save(reps.mapInArrow(_make_keys(percent, boundary, shared), _KEYS), "keys")
    known = components(members.where("n > 0").select(F.col("doc_id").alias("u"), F.col("component").alias("v")), scratch, "classes") if not unique else None
    entries = distinct_lists(keys.repartition("key").distinct())
    # Where a set stands too far back in a list for any of its sizes, it finds no partner there: it stays, but meets nobody.
    entries = entries.select("key", "doc_id", "n", "pos", F.col("pos").alias("rank"), F.col("doc_id").alias("component"), fitting_alone(percent).alias("fits"))
    listed = scratch.save(merged(entries, known), "listed")
    scratch.drop("keys")
    shared.destroy()
    scratch.release()
    # What a set shares with no other candidate is in no overlap, wherever a list finds it. Sets without a partner fit
    # nobody, and are the last to be an anchor.
    whole = _partnered(docs, listed.where("fits").select("doc_id").distinct(), k, percent, scratch)
    shared_by = whole.groupBy("doc_id", "n").agg(F.max("shared").alias("shared"))
    pos = F.greatest("pos", F.col("n") - F.coalesce("shared", F.lit(0))).alias("pos")
    rank = F.when(F.col("shared").isNotNull(), F.col("rank")).otherwise(F.col("n")).alias("rank")
    entries = listed.where("fits").join(shared_by, ["doc_id", "n"], "left").select("key", "doc_id", "n", pos, rank, "component")
    entries = entries.union(listed.where("not fits").select("key", "doc_id", "n", F.col("n").alias("pos"), F.col("n").alias("rank"), "component"))
    entries = scratch.save(entries, "entries")
    scratch.drop("listed")
    scratch.release()

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        if turn:  # of the pairs of a block or a list, most are told apart by what their prefixes show
            ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
            some = _pick(reps, ids, percent, common, scratch)
            u, v = (some.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("codes").alias(f"codes_{x}")) for x in "uv")
            near = pairs.join(u, "u").join(v, "v").select(*_PAIR, "n_u", "n_v", "codes_u", "codes_v").mapInArrow(_bound(percent), PAIRS)
            pairs = scratch.save(near if unique else near.distinct(), "near")
        u, v = (whole.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}")) for x in "uv")
        linked = pairs.join(u, "u").join(v, "v").select(*_PAIR, "set_u", "set_v").mapInArrow(verify(percent), PAIRS)
        linked = scratch.save(linked, f"linked-{turn}")
        scratch.drop("some", "near")
        scratch.release()
        return linked

    # With several texts an id its size and its bitmap might be those of two of them.
    detail = (lambda ids: _bitmaps(whole, ids, scratch)) if unique else None
    moved = settle(entries, verified, percent, scratch, detail, bitmaps_fit(percent) if unique else None)
    size = F.col("n").cast("long").alias("n_shingles")
    if unique:
        out = merged(members, moved).select("doc_id", size, F.col("component").alias("component_id"))
    else:
        labels = merged(known, moved).select(F.col("id").alias("doc_id"), F.col("component").alias("known"))
        out = merged(members.join(labels, "doc_id", "left").select("doc_id", "n", F.coalesce("known", "component").alias("component")), moved).select("doc_id", size, F.col("component").alias("component_id"))
    out = scratch.save(out, "result")
    scratch.only("result")
    common.destroy()
    return out
