"""Edge rows for every operator; recall of the bands; boundaries of the n-gram join; SQL of the queries that have it."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, chat_format, exact_dedup, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_ledger, sharding
from loomspark.llm.queries import ORACLES, QUERIES, pattern, vocabulary

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet \n" * 40_000  # over a megabyte
ROWS = [(None, "a row without an id", "x"), (1, None, None), (2, "", "x"), (3, LONG, "x"), (4, "twice the same", "y"), (4, "twice the same", "y"), (5, "twice the same", "y"), (6, " \t\n", "é")]
#: Columns that operators use inside.
CLASH = "sha string, block int, bit int, maybe int, u int, v int, slot int, shard string, key string, line string, component int, kept int, blob string, id int, signs int, spans int, n int, n_words int, tree int, score int"


@pytest.fixture(scope="module")
def edge(spark):
    n = len(CLASH.split(", "))
    return spark.createDataFrame([(*r, *([None] * n)) for r in ROWS], f"doc_id long, text string, source string, {CLASH}").cache()


OPERATORS = {
    "secrets": lambda d: secret_ledger.scan(d.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"), "spans", "blob")).by_path,
    "redact": secret_ledger.redact_documents,
    "lines": line_dedup.drop_lines,
    "bpe": lambda d: bpe.round_trip(d, vocabulary("byte_bpe_50k.tiktoken"), pattern()),
    "sharding": lambda d: sharding.place(d, "slot", ["a", "b"]),
    "rules": quality_rules.apply_rules,
    "join": ngram_join.jaccard_components,
    "exact": exact_dedup.duplicate_groups,
    "classifier": lambda d: quality_classifier.score(d, np.zeros((1 << quality_classifier.BITS) + 1)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_each_row_has_its_result(edge, name):
    assert OPERATORS[name](edge).count() == len(ROWS)
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_packing_covers_each_row(edge):
    pieces = packing.pack_documents(edge, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern()).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sum(r["start"] == 0 for r in pieces) == len(ROWS)


def test_equal_rows_fall_together(edge):
    exact = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_groups(edge).where("doc_id in (4, 5) or doc_id is null").collect()}
    assert exact == {(4, 4, 3, True), (5, 4, 3, False), (None, None, 1, True)}
    near = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(edge, 2, 80).collect()}
    assert near == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6)}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(edge).collect()}
    assert texts[4] == "twice the same" and texts[5] == "" and texts[1] is None and texts[3].count("lorem") == 1


def test_sharding_keeps_columns_of_its_own_names(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c")], "id int, slot string, Shard string, slot_ string")
    placed = sharding.place(rows, "slot", ["p", "q"])
    assert placed.columns[:1] != ["id_"] and sorted(placed.columns) == sorted(["id", "slot__", "Shard_", "slot_", "slot", "shard_id", "shard"])
    assert placed.first()["slot__"] == "a"


def test_repeated_messages_count_once(spark):
    schema = "conv_id long, msg_id long, parent_id long, role string, text string, score double"
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 2, 1, "assistant", "a", 0.0)]
    got = chat_format.format_messages(spark.createDataFrame(rows, schema)).select(chat_format.read_back(F.col("formatted")).alias("t")).collect()
    assert [[tuple(t) for t in r["t"]] for r in got] == [[("user", "hi"), ("assistant", "a")]]
    assert chat_format.format_messages(spark.createDataFrame([], schema)).count() == 0


def test_repeated_ids_do_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b d"), (1, None)] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert quality_classifier.training_sample(docs, labels).count() == 1


def test_bands_find_similar_lines():
    """Of random lines of 12 to 1000 characters, pairs of a similarity of 0.8 or more share a key with 0.95 or more."""
    rng, alphabet, found, pairs = random.Random(5), "abcdefghij klmnopqrstuvwxyz", {}, {}
    for size in (12, 16, 20, 24, 33, 40, 60, 66, 80, 130, 200, 400, 1000):
        for _ in range(250):
            x = "".join(rng.choice(alphabet) for _ in range(size)).strip() or "a"
            y = list(x)
            for _ in range(rng.randint(1, max(1, size // 40 + 1))):
                p = rng.randrange(len(y)) if rng.random() < 0.7 else len(y) - 1
                y[p : p + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet)])
            y = "".join(y)
            a, b = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (x, y))
            points, start, end, _, _ = line_dedup._lines([x, y])
            if a != b and len(start) == 2 and len(a & b) >= 0.8 * len(a | b):
                keys, row = line_dedup._bands(*line_dedup._windows(points, start, end))
                pairs[size] = pairs.get(size, 0) + 1
                found[size] = found.get(size, 0) + bool(set(keys[row == 0].ravel().tolist()) & set(keys[row == 1].ravel().tolist()))
    assert sum(pairs.values()) > 800
    assert all(found[s] >= 0.95 * pairs[s] - 1 for s in pairs), (found, pairs)


@pytest.mark.parametrize("boundary", [0, 6, 12, 40, None])
def test_boundaries_give_the_same(spark, boundary):
    """Sets on both sides of the boundary, and pairs across it, against all pairs."""
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice((3, 5, 6, 8, 9, 10, 13, 15, 20, 45)))] for _ in range(40)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(80):
        w = list(rng.choice(base))
        w[rng.choice((0, len(w) - 1))] = "new" if rng.random() < 0.6 else w[0]
        texts.append((100 + i, " ".join(w + ["tail"] * rng.randint(0, 1))))
    sets = {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or {tuple(w)}
    least = {i: i for i in sets}
    for _ in range(6):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    rows = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 80, boundary).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == least and sum(least[i] != i for i in least) > 20


def test_boundary_is_where_subsets_pay():
    sizes = {s: 100 for s in range(1, 60)}
    assert ngram_join.cheapest_boundary(sizes, {}, 85) == 0
    assert ngram_join.cheapest_boundary(sizes, {s: 0.4 for s in sizes}, 85) == 6
    assert ngram_join.cheapest_boundary(sizes, {s: 3.0 for s in sizes}, 85) > 20


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine = QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = con.sql(f"select {', '.join(cols)} from ({ORACLES[name]}) q").fetchall()
    assert sorted(map(tuple, mine.select(*cols).collect()), key=str) == sorted(theirs, key=str)
