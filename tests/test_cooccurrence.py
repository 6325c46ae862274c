"""Band joins against all pairs."""

import random

import pytest

from loomspark.operators import cooccurrence as C


@pytest.mark.parametrize("width", [1, 2, 7])
def test_within_equals_all_pairs(spark, width):
    rng = random.Random(width)
    rows = lambda n: [(rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 40), rng.choice("ab")) for _ in range(n)]
    left, right = [*rows(60), (9, 1, "a")], [*rows(60), (8, 1, "a")]
    schema = "id long, line long, word string"
    pairs = C.within(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "id", "line", width)
    want = sorted((*a, *b[1:]) for a in left for b in right if a[0] == b[0] and abs(a[1] - b[1]) <= width)
    assert sorted(tuple(r) for r in pairs.select("id", "line", "word", "other_line", "other_word").collect()) == want
    best = {}
    for i, line, word, other, other_word in want:
        best[i, line, word] = min(best.get((i, line, word), (99, 0, "")), (abs(line - other), other, other_word))
    got = C.nearest(pairs, ["id", "line", "word"], "line", ["other_word"]).collect()
    assert {(r["id"], r["line"], r["word"]): (r["distance"], r["other_line"], r["other_word"]) for r in got} == best


def test_words_and_files(spark):
    docs = spark.createDataFrame([(1, "a x a\n\nb"), (2, "a"), (3, None), (4, ""), (5, "b\nb a")], "id long, text string")
    a, b = (C.words_by_line(docs, "id", "text", rf"\b({w})\b") for w in "ab")
    assert sorted(map(tuple, a.collect())) == [(1, 1, "a"), (2, 1, "a"), (5, 2, "a")]
    assert sorted(map(tuple, C.in_one_file(a, b, "id").collect())) == [(1, 3, "b"), (5, 1, "b")]


def test_words_beside_other_letters_are_those_of_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["使用token进行\nélde License", "mit密码password\nünd", "étoken\nwithé", "token_ de", "tokens\nwith", "naïve secret,der die de", None, "", "_token with\ntoken1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["cooccurrence_candidates"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(connection.execute(entry.oracle_sql()["cooccurrence_candidates"]).fetchall())
    assert got == want and {r[0] for r in got} >= {0, 2}
