"""JSON texts that many rows share are validated once, for all of them."""

import contextlib
import io

import duckdb

import __spark_entry__ as entry


def test_equal_texts_are_parsed_once(spark, tmp_path):
    rows = [(("view", "click")[i % 2], f'{{"k": {i % 3}}}') for i in range(50)]
    spark.createDataFrame(rows, "event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["json_schema_errors"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(connection.execute(entry.oracle_sql()["json_schema_errors"]).fetchall())
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        found.explain()
    plan = held.getvalue().split("Initial Plan")[-1]
    assert "HashAggregate" in plan[plan.rindex("Generate explode") :], "texts are counted before they are parsed"
