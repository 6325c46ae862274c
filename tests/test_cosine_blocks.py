"""Cosines by blocks against the expression that computes one, and the queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.operators import retrieval as R


@pytest.mark.parametrize("size", [3, 2048])
def test_blocks_give_sql_rows(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    few = [[rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(4)] for _ in range(5)]
    rows = [(i * 20, few[rng.randrange(5)] if i % 2 else [rng.random() - 0.5 for _ in range(4)], rng.randrange(3) if i else 9) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(R, "BLOCK_ROWS", size)
    monkeypatch.setattr(R, "BLOCK_QUERIES", size)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("cosine_topk", "recall_mrr"):
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
        assert got == sorted(connection.execute(entry.oracle_sql()[name]).fetchall()), name


def test_doubtful_roundings_are_those_of_the_expression(spark):
    rows = [(i, [1.0, i / 977], i % 3) for i in range(300)] + [(1000, [0.0, 0.0], 1), (1001, None, 1), (1002, [1.0], None)]
    table = spark.createDataFrame(rows, "id long, v array<float>, label int").select("id", "label", "v")
    queries = table.where("id in (0, 100, 1000)")
    got = {(r["query"], r["id"]): r["millionths"] for r in R.nearest(table, queries, 1000).collect()}
    alike = F.round(F.coalesce(R.cosine(F.col("q"), F.col("v")), F.lit(0.0)), 6)
    pairs = queries.select(F.col("id").alias("query"), F.col("v").alias("q")).crossJoin(table).where("query != id").select("query", "id", alike.alias("c"))
    assert got == {(r["query"], r["id"]): round(r["c"] * 1e6) for r in pairs.collect()}


def test_no_row_of_the_pairs_is_made(spark):
    import contextlib
    import io

    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        entry.queries()["recall_mrr"](spark, "/root/testdata/sf0.001").explain()
    assert "zip_with" not in held.getvalue()
