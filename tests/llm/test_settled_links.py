"""Components of links in few jobs, and which lists and lines need no further work."""

import random

import pyarrow as pa
import pytest

from loomspark.llm import components, line_dedup
from loomspark.llm.store import Scratch


def least_of(links):
    """Union-find by hand: id -> smallest id that it reaches."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u != v:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    return {x: root(x) for x in up}


class Counted(Scratch):
    saved = ()

    def save(self, df, name):
        self.saved += (name,)
        return super().save(df, name)


def chains(seed):
    r = random.Random(seed)
    ids = r.sample(range(-(10**12), 10**12), 400)
    links = [(a, b) for a, b in zip(ids[:300], ids[1:300])] + [(r.choice(ids[300:]), r.choice(ids[300:])) for _ in range(60)]
    return [(b, a) if r.random() < 0.5 else (a, b) for a, b in links]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_of_a_long_chain_take_few_rounds(spark, parts):
    links = chains(parts)
    scratch = Counted(spark, "test-links")
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(parts), scratch, "c")
    rows = [tuple(r) for r in got.select("id", "component").collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == least_of(links)
    assert len(scratch.saved) <= 3


def test_links_of_later_rounds_move_what_moved_before(spark):
    # A list of three: the anchor links with one, and that one with the third only, so two rounds each move something.
    entries = [("k", i, 10, 0, rank, i) for i, rank in ((5, 0), (3, 1), (1, 2))] + [("l", i, 10, 0, 0, i) for i in (8, 9)]
    linked = {(3, 5), (1, 3)}
    asked = []

    def verified(pairs, turn):
        rows = [tuple(r) for r in pairs.select("u", "v", "cu", "cv").collect()]
        asked.extend(tuple(sorted(r[:2])) for r in rows)
        return spark.createDataFrame([r for r in rows if tuple(sorted(r[:2])) in linked], "u long, v long, cu long, cv long")

    table = spark.createDataFrame(entries, "key string, doc_id long, n int, pos int, rank int, component long")
    scratch = Counted(spark, "test-settle")
    moved = {r["id"]: r["component"] for r in components.settle(table, verified, 80, scratch).collect()}
    assert moved == {5: 1, 3: 1, 1: 1}
    assert asked.count((8, 9)) == 1 and len(asked) == len(set(asked))


def test_a_list_of_two_that_have_met_is_done(spark):
    table = spark.createDataFrame([("k", i, 10, 0, 0, i) for i in (8, 9)], "key string, doc_id long, n int, pos int, rank int, component long")
    scratch = Counted(spark, "test-two")
    components.settle(table, lambda pairs, _: pairs.select("u", "v", "cu", "cv").where("false"), 80, scratch)
    assert "fitting-1" not in scratch.saved


def test_packed_keys_are_read_back():
    b = pa.RecordBatch.from_pydict({"line": [1, 2, 3, 4], "keys": pa.array([[5, -6], [], [7], []], pa.list_(pa.int64()))})
    (packed,) = line_dedup._packed(iter([b]))
    for part, want in ((packed, [[5, -6], [], [7], []]), (packed.slice(1), [[], [7], []]), (packed.slice(1, 1), [[]])):
        (got,) = line_dedup._unpacked(iter([part]))
        assert got.column("keys").to_pylist() == want


def test_lines_that_occur_once_stay_and_others_are_told(spark):
    lines = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 0, 10), (None, 3, 30), (4, 0, 40), (3, 7, 50)], "doc_id long, line_no long, line long")
    moved = spark.createDataFrame([(40, 30), (30, 30)], "id long, component long")
    for now, part in ((moved, 30), (None, 40)):
        got = {tuple(r) for r in line_dedup._kept(lines, now, Scratch(spark, "test-kept")).collect()}
        assert got == {(1, 0, 10, 10, True), (2, 0, 10, 10, False), (1, 1, 20, 20, True), (3, 7, 50, 50, True), (None, 3, 30, 30, now is None), (4, 0, 40, part, True)}
