"""Files under their own paths: the tree equals its source, and a run that fails leaves nothing."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.sinks import files, tree


def content_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def write(rows, root):
    tree.register(rows.sparkSession)
    rows.write.format("filetree").mode("append").save(str(root))


def test_tree_equals_its_source(spark, tmp_path):
    rng, source = random.Random(4), tmp_path / "source"
    for i in range(300):
        at = source / "/".join(rng.choice(["a", "b", "é ü", "deep"]) for _ in range(rng.randint(0, 4))) / f"f {i}.bin"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(rng.randbytes(rng.choice([0, 1, 100, 70_000])))
    rows = spark.createDataFrame(list(content_of(source).items()), tree.SCHEMA).repartition(7)
    write(rows, tmp_path / "out/made/here")
    assert content_of(tmp_path / "out/made/here") == content_of(source)
    assert [p.name for p in (tmp_path / "out/made").iterdir()] == ["here"]
    with pytest.raises(Exception, match="not empty"):
        write(rows, tmp_path / "out/made/here")
    assert content_of(tmp_path / "out") == {f"made/here/{k}": v for k, v in content_of(source).items()} and [p.name for p in (tmp_path / "out/made").iterdir()] == ["here"]


def test_aborted_task_leaves_nothing(spark, tmp_path):
    @F.udf("binary")
    def breaks(i):
        if i == 37:
            raise ValueError("a task fails")
        return b"x"

    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("place"), breaks("id").alias("content"))
    with pytest.raises(Exception, match="a task fails"):
        write(rows, tmp_path / "out/here")
    assert content_of(tmp_path) == {} and not (tmp_path / "out/here").exists() and not list((tmp_path / "out").iterdir())


@pytest.mark.parametrize("places", [("a", "a"), ("a", "a/b"), ("x/../../y",), ("/etc/x",), (None,), ("a//b",)])
def test_conflicts_leave_nothing(spark, tmp_path, places):
    rows = spark.createDataFrame([(p, b"x") for p in (*places, "other/file")], tree.SCHEMA).repartition(3)
    with pytest.raises(Exception, match="no file can be written|two files"):
        write(rows, tmp_path / "out/here")
    assert content_of(tmp_path) == {} and not (tmp_path / "out/here").exists()


def test_generated_files_are_checked_before(spark, tmp_path):
    rows = spark.createDataFrame([("a.ts", "x"), ("a.ts/b.ts", "y"), ("c/d.ts", "z")], "path string, content string")
    with pytest.raises(files.Refused, match="folder of another"):
        files.write_generated(rows, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    made = files.write_generated(rows.where("path != 'a.ts/b.ts'"), f"{tmp_path}/out")
    assert {tuple(r) for r in made.collect()} == {("a.ts", 1), ("c/d.ts", 1)} and content_of(tmp_path / "out") == {"a.ts": b"x", "c/d.ts": b"z"}


def test_empty_folder_is_taken(spark, tmp_path):
    (tmp_path / "out").mkdir()
    write(spark.createDataFrame([("a", b"1")], tree.SCHEMA), tmp_path / "out")
    assert content_of(tmp_path / "out") == {"a": b"1"}
