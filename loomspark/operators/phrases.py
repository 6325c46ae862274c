"""Many phrases looked for in many texts at once, by an automaton that every task holds.

The phrases of one automaton are at most PHRASE_BYTES, counted before they are collected and broadcast. More of them
are dealt to several automata by their hash, each a pass over the texts. What a text then has is the union, and what is
chosen among overlapping matches is chosen over all of them, so results do not depend on the number of automata.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the phrases of one automaton; in memory it takes some fifty times as much.
PHRASE_BYTES = 4 << 20
_BUILT: dict[str, object] = {}


def _automaton(key: str, phrases: list[str]):
    """The automaton of these phrases, built once in a Python worker."""
    if key not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for phrase in phrases:
            built.add_word(phrase, phrase)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def occurrences(automaton, text: str) -> list[tuple[int, str]]:
    """(start, phrase) of all matches, overlapping ones too, from the left and the longest first."""
    return sorted(((end - len(phrase) + 1, phrase) for end, phrase in automaton.iter(text)), key=lambda m: (m[0], -len(m[1])))


def leftmost_longest(matches: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of matches as occurrences gives them those that a search takes that goes on behind each match."""
    out, free = [], 0
    for start, phrase in matches:
        if start >= free:
            out.append((start, phrase))
            free = start + len(phrase)
    return out


def _firsts(matches: list[tuple[int, str]]) -> list[tuple[int, str]]:
    seen: dict[str, int] = {}
    for start, phrase in matches:
        seen.setdefault(phrase, start)
    return [(start, phrase) for phrase, start in seen.items()]


def _automata(phrases: DataFrame, limit: int) -> list:
    """Broadcast lists of phrases, each of limit bytes at most (a single longer phrase alone). Null and empty ones match nothing."""
    held = phrases.select(F.col("phrase").cast("string").alias("phrase")).where("phrase != ''").distinct()
    total = held.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    spark, out, parts = phrases.sparkSession, [], max(1, -(-2 * total // limit)) if total > limit else 1
    for i in range(parts):
        part = held if parts == 1 else held.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)
        if listed := sorted(r["phrase"] for r in part.collect()):
            out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(listed)))
    return out


def _schema(rows: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + more


def _search(rows: DataFrame, keys: list[str], automaton: tuple, choose, lines: bool = False) -> DataFrame:
    """(keys, position, phrase): what choose keeps of each row's matches; positions from 1. With lines their numbers too."""
    key, phrases = automaton

    def run(batches):
        built = _automaton(key, phrases.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, position, phrase, line = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    at_line, last = 1, 0
                    for start, found in choose(occurrences(built, text or "")):
                        if lines:
                            at_line += text.count("\n", last, start)
                            last = start
                            line.append(at_line)
                        row.append(i)
                        position.append(start + 1)
                        phrase.append(found)
                held = [part.column(k).take(pa.array(row, pa.int32())) for k in keys]
                more = [pa.array(line, pa.int64())] if lines else []
                yield pa.RecordBatch.from_arrays([*held, pa.array(position, pa.int64()), pa.array(phrase, pa.string()), *more], [*keys, "position", "phrase", *["line"] * lines])

    return rows.select(*(F.col(f"`{k}`") for k in keys), F.col("text").cast("string").alias("text")).mapInArrow(run, _schema(rows, keys, "position long, phrase string" + ", line long" * lines))


def first_matches(rows: DataFrame, phrases: DataFrame, keys: list[str], limit: int = PHRASE_BYTES, lines: bool = False) -> DataFrame:
    """rows (keys, text), phrases (phrase) -> (keys, position, phrase): for each row every phrase that it holds, and where
    first; with lines also (line), from 1.

    Matches may overlap. Null texts hold none. Repeated rows give their matches once each."""
    out = None
    for automaton in _automata(phrases, limit):
        found = _search(rows, keys, automaton, _firsts, lines)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], _schema(rows, keys, "position long, phrase string" + ", line long" * lines))


def longest_matches(rows: DataFrame, phrases: DataFrame, keys: list[str], limit: int = PHRASE_BYTES) -> DataFrame:
    """rows (keys, text), phrases (phrase) -> (keys, position, phrase): the matches of one alternation of all phrases, the
    longest first: from the left, the longest where several start, and on behind it.

    With several automata, rows of equal keys and texts are searched as one and their matches given as often as there are
    rows; a row's matches meet in one group, which is no larger than its text."""
    built = _automata(phrases, limit)
    if len(built) == 1:
        return _search(rows, keys, built[0], leftmost_longest)
    if not built:
        return first_matches(rows, phrases, keys, limit)
    marked = rows.withColumn("_sha", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    grouped = [*keys, "_sha"]
    every = None
    for automaton in built:
        found = _search(marked, grouped, automaton, lambda m: m)
        every = found if every is None else every.unionByName(found)

    def choose(matches: pa.Table) -> pa.Table:
        found = zip((p - 1 for p in matches.column("position").to_pylist()), matches.column("phrase").to_pylist(), strict=True)
        kept = leftmost_longest(sorted(set(found), key=lambda m: (m[0], -len(m[1]))))
        head = [matches.column(k).take(pa.array([0] * len(kept))) for k in grouped]
        return pa.table([*head, pa.array([p + 1 for p, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())], [*grouped, "position", "phrase"])

    chosen = every.groupBy(*grouped).applyInArrow(choose, _schema(marked, grouped, "position long, phrase string"))
    copies = marked.groupBy(*grouped).agg(F.count("*").alias("_n")).where("_n > 1")
    same = None
    for k in grouped:
        test = chosen[k].eqNullSafe(copies[k])
        same = test if same is None else same & test
    both = chosen.join(copies, same, "left").select(*(chosen[k] for k in keys), "position", "phrase", F.coalesce("_n", F.lit(1)).alias("_n"))
    return both.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
