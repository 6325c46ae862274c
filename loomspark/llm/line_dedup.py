"""Fuzzy line deduplication by MinHash.

Lines are lower-cased and hashed by their distinct windows of five characters. One-permutation MinHash puts
hashes into one of BANDS * ROWS bins and keeps the least of each bin; an empty bin borrows from the next, which
is in another band. Each band of ROWS values is a key; lines that share a key are candidates, verified by the
exact Jaccard similarity of their windows and merged by distributed union-find. One line of each component stays.

So that a line of few windows has few empty bins, each of its windows gives several hashes. How many is fixed by
a class of sizes, each up to twice the next one's; a line that may have a partner in the next class, as it has
more than 0.8 times that one's least size, has keys there too.

With ROWS = 6 and BANDS = 18 a pair of similarity 0.8 shares a key with probability 0.996, one of 0.9 with
0.99999, one of 0.1 with 0.00002.

Before the candidates of a list are paired, bitmaps of their windows bound how much two of them share: an exact
test, which lines with a long passage in common, but too much of their own beside it, do not pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import batch
from loomspark.llm.components import bitmaps_fit, distinct_lists, merged, settle
from loomspark.llm.idfilter import hits, id_filter, wanted_rows, xxhash_bits
from loomspark.llm.ngram_join import PAIRS, jaccard_at_least
from loomspark.llm.repeats import may_repeat, repeated
from loomspark.llm.store import Scratch

WINDOW = 5
ROWS, BANDS = 6, 18
PERCENT = 80
#: (hashes a window, most windows of a line) of each class; a class begins above 0.4 times its most.
CLASSES = ((64, 4), (32, 8), (16, 16), (8, 32), (4, 64), (2, 128), (1, 1 << 40))
#: 64-bit words of a line's bitmap of windows.
WORDS = 64
_BLANK = np.zeros(128, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_PLACES = batch.random_values(WINDOW, 7) | np.uint64(1)
_SEEDS = batch.random_values(64, 11) | np.uint64(1)
_U = np.uint64


def _lines(texts: list[str | None]):
    """Of some texts: code points, and start, end, text index and number in its text of each line that has a
    character other than white space."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    newline = np.flatnonzero(points == 10)
    start, end = np.concatenate(([0], newline + 1)), np.concatenate((newline, [len(points)]))
    doc_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered])))
    doc = np.searchsorted(doc_start, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(doc, doc)
    solid = np.concatenate(([0], np.cumsum(~((points < 128) & _BLANK[np.minimum(points, 127)]))))
    full = solid[end] > solid[start]
    return points, start[full], end[full], doc[full], number[full]


def _windows(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of each line, line by line, and how many a line has; a shorter line is one."""
    wide = np.concatenate((points, np.zeros(WINDOW, np.uint32))).astype(_U)
    wide += _U(1)
    n = len(points)
    value, part = wide[:n] * _PLACES[0], np.empty(n, _U)
    for j in range(1, WINDOW):
        value += np.multiply(wide[j : n + j], _PLACES[j], out=part)
    count = np.maximum(end - start - WINDOW + 1, 1)
    at = np.arange(count.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    out = value[at]
    short = np.flatnonzero(end - start < WINDOW)
    if short.size:
        first = np.concatenate(([0], np.cumsum(count)))[short]
        whole = np.zeros(len(short), _U)
        for j in range(WINDOW - 1):
            inside = end[short] - start[short] > j
            whole[inside] += wide[start[short][inside] + j] * _PLACES[j]
        out[first] = whole + (end[short] - start[short]).astype(_U) * _U(0xD6E8FEB86659FD93)
    return batch.mix(out), count


#: Hashes of the code points below 2**16.
_POINTS = batch.mix(np.arange(1, (1 << 16) + 1, dtype=_U))


def _line_hash(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    few = len(points) == 0 or int(points.max()) < len(_POINTS)
    values = _POINTS[points] if few else batch.mix(points.astype(_U) + _U(1))
    return batch.span_hash(batch.running_hash(values), start, end).view(np.int64)


def _borrowed(low: np.ndarray) -> np.ndarray:
    """low with each empty bin's value made of the next bin that has one, after the last one the first."""
    bins = low.shape[1]
    empty = low == ~_U(0)
    at = np.where(empty, bins, np.arange(bins))
    at = np.where(empty, at.min(1, keepdims=True) + bins, at)  # as if the first one stood again after the last
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    steps = (at - np.arange(bins)).astype(_U)
    return np.take_along_axis(low, at % bins, 1) + steps * _U(0x9E3779B97F4A7C15)


def _bands(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines' bands, BANDS for each (line, class), and the line that each such row is of."""
    bins, keys, rows = ROWS * BANDS, [], []
    for seeds, most in CLASSES:
        least = most * 2 // 5 if seeds > 1 else CLASSES[-2][1] * 4 // 5
        inside = (count > least) & (count <= most)
        n = count[inside]
        if not len(n):
            continue
        mine = values[np.repeat(inside, count)]
        low = np.full(len(n) * bins, ~_U(0))
        at = np.repeat(np.arange(len(n)) * bins, n)
        for j in range(seeds):
            hashed = mine * _SEEDS[j]
            np.minimum.at(low, at + ((hashed >> _U(40)) * _U(bins) >> _U(24)).view(np.int64), hashed)
        low = low.reshape(-1, bins)
        lack = np.flatnonzero((low == ~_U(0)).any(1))
        if len(lack):
            low[lack] = _borrowed(low[lack])
        key = np.full((len(n), BANDS), _U(seeds))
        for j in range(ROWS):
            key = key * _U(0xA0761D6478BD642F) + low[:, j * BANDS : (j + 1) * BANDS]
        keys.append(batch.mix(key ^ _SEEDS[:BANDS]))
        rows.append(np.flatnonzero(inside))
    return np.concatenate([*keys, np.zeros((0, BANDS), _U)]), np.concatenate([*rows, np.zeros(0, np.int64)])


def _parts(b: pa.RecordBatch, step: int = 64):
    for i in range(0, b.num_rows, step):
        part = b.slice(i, step)
        yield part, _lines(part.column("text").to_pylist())


#: Lines that a task remembers to have met; beyond, it may take some for new again.
_SEEN = 1 << 18


def _fresh(line: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of some lines (hashes) their task meets for the first time; they are put into seen."""
    first = np.unique(line, return_index=True)[1]
    first = first[[x not in seen for x in line[first].tolist()]]
    if len(seen) >= _SEEN:
        seen.clear()
    seen.update(line[first].tolist())
    out = np.zeros(len(line), bool)
    out[first] = True
    return out


def _spread(batches):
    """Task side: the lines of texts with their keys. A line that a task meets again has none, so that a line of very
    many texts is sent once a task."""
    seen: set[int] = set()
    for b in batches:
        for part, (points, start, end, doc, number) in _parts(b):
            if not len(start):
                continue
            line = _line_hash(points, start, end)
            mask = _fresh(line, seen)
            keys, row = _bands(*_windows(points, start[mask], end[mask]))
            turn = np.argsort(row, kind="stable")
            per = np.zeros(len(line) + 1, np.int32)
            per[1:][mask] = np.bincount(row, minlength=int(mask.sum())) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(per, dtype=np.int32)), pa.array(keys[turn].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(number), pa.array(line), lists], ["doc_id", "line_no", "line", "keys"])


def _packed(batches):
    """Task side: batches with each row's keys as bytes, which Spark writes and reads far faster than arrays of numbers."""
    for b in batches:
        at, lists = b.schema.get_field_index("keys"), b.column("keys")
        yield b.set_column(at, "keys", batch.binaries(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())))


def _unpacked(batches):
    """Task side: _packed undone."""
    for b in batches:
        at, packed = b.schema.get_field_index("keys"), b.column("keys")
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        keys = np.frombuffer(packed.buffers()[2] or b"", "<i8", (ends[-1] - ends[0]) // 8, ends[0]) if len(ends) and ends[-1] > ends[0] else np.zeros(0, np.int64)
        yield b.set_column(at, "keys", pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 8), pa.array(keys)))


def _keys_and_lines(batches):
    """Task side: of lines with their keys the keys, and the line of each."""
    for b in batches:
        lists, line = b.column("keys"), b.column("line").to_numpy()
        keys = lists.flatten().to_numpy(zero_copy_only=False).view(_U)
        yield keys, np.repeat(line, np.diff(lists.offsets.to_numpy()))


def _owned_keys(batches):
    """The keys of a task's lines, and whose they are. One line's keys, however often it occurs, have one owner."""
    for keys, line in _keys_and_lines(_unpacked(batches)):
        if len(keys):
            yield keys, ((keys ^ line.view(_U)) * _U(0xD6E8FEB86659FD93) >> _U(48)).astype(np.uint16)


def _repeated_keys(shared):
    """Task side: those keys that more than one line may have, as entries of lists of lines."""

    def run(batches):
        for keys, line in _keys_and_lines(_unpacked(batches)):
            some = may_repeat(shared.value, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(line[some]), pa.array(np.zeros(int(some.sum()), np.int32))], ["key", "doc_id", "pos"])

    return run


def _window_sets(texts: list[str], step: int = 512):
    """Of lines their distinct windows, some lines at a time: (first line, windows in order, how many each has)."""
    for i in range(0, len(texts), step):
        some = texts[i : i + step]
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
        end = np.cumsum([len(t) for t in some])
        yield i, *batch.row_sets(*_windows(points, np.concatenate(([0], end[:-1])), end))


def _verify(batches):
    """Task side: of pairs of lines those of a similarity of PERCENT or more."""
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for (i, x, n), (_, y, m) in zip(_window_sets(b.column("text_u").to_pylist()), _window_sets(b.column("text_v").to_pylist()), strict=True):
            x_end, y_end = np.cumsum(n).tolist(), np.cumsum(m).tolist()
            for j, (p, q, s, t) in enumerate(zip(n.tolist(), m.tolist(), x_end, y_end, strict=True)):
                keep[i + j] = jaccard_at_least(x[s - p : s], y[t - q : t], PERCENT)
        yield b.filter(pa.array(keep)).select(["u", "v", "cu", "cv"])


def _measure(batches):
    """Task side: each line's number of distinct windows."""
    for b in batches:
        n = np.concatenate([n for _, _, n in _window_sets(b.column("text").to_pylist())] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("rank"), pa.array(n.astype(np.int32))], ["doc_id", "text", "rank", "n"])


def _bitmaps(batches):
    """Task side: the bitmap of each line's windows, and how many bits it has."""
    for b in batches:
        for i, values, n in _window_sets(b.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(n)), *batch.bitmaps(values, n, WORDS)], ["doc_id", "words", "set"])


def line_components(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, line_no, line, component, kept), a row a line that is not blank.

    line_no counts the text's \\n-separated lines from 0; line is the hash of the lower-cased line, component
    the smallest such hash that it reaches by similarities of 0.8 or more. Of a component the line of the
    smallest (doc_id, line_no) is kept, a null doc_id last; rows that repeat a whole document keep the same
    line each. Blank lines, null and empty texts have no row here."""
    scratch = Scratch(documents.sparkSession, "lines")
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    # Keys are computed once, and dropped from disk when those that repeat are known.
    spread = scratch.save(docs.mapInArrow(lambda batches: _packed(_spread(batches)), f"doc_id {kind}, line_no long, line long, keys binary"), "spread")
    lines = scratch.save(spread.drop("keys"), "lines")
    own = spread.where("octet_length(keys) > 0").select("line", "keys")
    shared = repeated(own, _owned_keys)
    some = scratch.save(own.mapInArrow(_repeated_keys(shared), "key long, doc_id long, pos int"), "keys")
    shared.destroy()
    scratch.drop("spread")
    # Dealt by key once, for what follows up to the listed candidates.
    some = some.repartition("key").distinct()
    listed = scratch.save(distinct_lists(some), "listed")
    wanted = listed.select("doc_id").distinct()
    line_bits, _ = id_filter(wanted)

    def fetch(batches):
        for b in batches:
            for _, (points, start, end, _doc, _no) in _parts(b):
                if len(start):
                    line = _line_hash(points, start, end)
                    keep = np.flatnonzero(hits(line_bits.value, xxhash_bits(line)))
                    if len(keep):
                        text = [points[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(line[keep]), pa.array(text)], ["doc_id", "text"])

    fetched = docs.select("text").mapInArrow(fetch, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text"), (-F.count("*")).alias("rank"))
    whole = scratch.save(fetched.join(wanted, "doc_id", "left_semi").mapInArrow(_measure, "doc_id long, text string, rank long, n int"), "whole")
    line_bits.destroy()
    # The line that most texts have, as a passage's own wording, is likely to be the one that its variants link to.
    entries = listed.join(whole.select("doc_id", "n", "rank"), "doc_id").select("key", "doc_id", "n", F.lit(0).alias("pos"), "rank", F.col("doc_id").alias("component"))
    entries = scratch.save(entries, "entries")
    scratch.drop("listed", "keys")
    scratch.release()

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        some, only, wanted = wanted_rows(whole.select("doc_id", "text"), pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")))
        some = some.mapInArrow(lambda batches: (b.select(["doc_id", "text"]) for b in only(batches)), "doc_id long, text string")
        u, v = (some.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
        linked = scratch.save(pairs.join(u, "u").join(v, "v").select("u", "v", "cu", "cv", "text_u", "text_v").mapInArrow(_verify, PAIRS), f"linked-{turn}")
        wanted.destroy()
        return linked

    def bitmaps(ids: DataFrame) -> DataFrame:
        some, only, wanted = wanted_rows(whole.select("doc_id", "text"), ids)
        made = scratch.save(some.mapInArrow(lambda batches: _bitmaps(only(batches)), "doc_id long, words array<long>, set int"), "bitmaps")
        wanted.destroy()
        return made

    moved = settle(entries, verified, PERCENT, scratch, bitmaps, bitmaps_fit(PERCENT))
    out = _kept(lines, moved, scratch)
    scratch.only("result")
    return out


def _kept(lines: DataFrame, moved: DataFrame | None, scratch: Scratch) -> DataFrame:
    """lines (doc_id, line_no, line) with the component of each, and whether it is the one that stays. A line that
    occurs once and is linked with none stays, and is told apart where it is read; only others are shuffled."""
    columns = "doc_id", "line_no", "line", "component"
    again = repeated(lines.select("line"), lambda batches: ((b.column("line").to_numpy().view(_U), None) for b in batches))
    linked = None if moved is None else id_filter(moved.select(F.col("id").alias("doc_id")))[0]

    def told(batches):
        for b in batches:
            line = b.column("line").to_numpy()
            meets = may_repeat(again.value, line)
            if linked is not None:
                meets |= hits(linked.value, xxhash_bits(line))
            yield b.append_column("meets", pa.array(meets))

    schema = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, line_no long, line long, meets boolean"
    lines = lines.mapInArrow(told, schema).withColumn("component", F.col("line"))
    alone = lines.where("not meets").select(*columns, F.lit(True).alias("kept"))
    held = merged(lines.where("meets").select(*columns), moved)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    first = held.groupBy("component").agg(F.min(place).alias("first"))
    out = scratch.save(alone.union(held.join(first, "component").select(*columns, place.eqNullSafe(F.col("first")).alias("kept"))), "result")
    again.destroy()
    if linked is not None:
        linked.destroy()
    return out


def summarise(documents: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_lines, n_kept, dropped): the numbers of the dropped lines, comma-joined.

    A row for each doc_id; blank lines are not counted and are never dropped."""
    lines = line_components(documents)
    dropped = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))), lambda x: x.cast("string")), ",")
    # A row without a line for each document, so that those without lines are there too.
    ids = documents.select("doc_id", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("boolean").alias("kept"))
    both = lines.select("doc_id", "line_no", "kept").union(ids)
    return both.groupBy("doc_id").agg(F.count("line_no").alias("n_lines"), F.count_if("kept").alias("n_kept"), dropped.alias("dropped"))


def drop_lines(documents: DataFrame) -> DataFrame:
    """documents with the dropped lines taken out of `text`; all rows and columns stay. Null stays null."""
    numbers = F.transform(F.split("dropped", ","), lambda x: x.cast("int"))
    # A sign a line up to the last dropped one, so that each line finds its own at once.
    signs = F.transform(F.col("n"), lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("n", i - 1), F.lit(-1)) - 1), F.lit("1")))
    gone = summarise(documents).where("dropped != ''").select(F.col("doc_id").alias("id"), numbers.alias("n")).select("id", F.split(F.array_join(signs, ""), "").alias("signs"))
    held = documents.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.id")), "left")
    left = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda x, i: F.coalesce(F.get("g.signs", i) != "1", F.lit(True))), "\n")
    text = F.when(F.col("g.signs").isNull(), F.col("d.text")).otherwise(left)
    return held.select(*(text.alias(c) if c.lower() == "text" else F.col(f"d.`{c}`").alias(c) for c in documents.columns))
