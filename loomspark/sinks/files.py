"""Results as files: JSON in two forms, mirrored layouts, reports, and writers that write all or nothing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.names import generated_path, source_id
from loomspark.sinks import tree


class Refused(ValueError):
    """Nothing was written; `violations` says why."""

    def __init__(self, violations: DataFrame):
        self.violations = violations
        first = violations.limit(5).collect()
        super().__init__("; ".join(str(r.asDict()) for r in first))


def pretty(text: Column, sort_keys: bool = False) -> Column:
    """A JSON text indented by two, other letters than ASCII kept, keys in order if asked, and a final line end then."""

    @F.pandas_udf("string")
    def run(values):
        end = "\n" if sort_keys else ""
        return values.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2, sort_keys=sort_keys) + end)

    return run(text)


def absent(spark: SparkSession, path: str) -> None:
    """Raise FileExistsError if a folder is there and not empty: evidence of an earlier run is never overwritten."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and len(fs.listStatus(at)):
        raise FileExistsError(f"{path} exists and is not empty; name another run")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A line a row with keys in order; in as many files as there are partitions, into a folder that must not exist."""
    keys = sorted(rows.columns)
    rows.select(F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _violations(files: DataFrame, place: Column) -> DataFrame:
    held = files.select("path", "content", place.alias("place"))
    empty = held.where(F.trim(F.coalesce(F.regexp_replace("content", r"\s", ""), F.lit(""))) == "").select("path", F.lit("empty file").alias("violation"))
    bad = held.where("place is null").select("path", F.lit("path not allowed").alias("violation"))
    placed = held.where("place is not null").select("place")
    twice = placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select(F.col("place").alias("path"), F.lit("path given twice").alias("violation"))
    parts = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = placed.where(F.size(parts) > 1).select(F.explode(above).alias("place")).distinct()
    under = placed.distinct().join(folders, "place", "left_semi").select(F.col("place").alias("path"), F.lit("path is a folder of another").alias("violation"))
    return empty.unionByName(bad).unionByName(twice).unionByName(under)


def violations(files: DataFrame) -> DataFrame:
    """(path, violation) of generated files (path, content): empty ones, paths that are not allowed, that are given twice,
    or that are a folder of another file's."""
    return _violations(files, generated_path(F.col("path")))


def _write_each(files: DataFrame, root: str) -> DataFrame:
    """Write each (place, content) row as a file of its own below root, byte for byte: staged by the executors, moved to
    their places by one commit."""
    tree.register(files.sparkSession)
    files.select("place", F.col("content").cast("binary").alias("content")).write.format("filetree").mode("append").save(root)
    return files.select("place", F.octet_length("content").alias("bytes"))


def write_generated(files: DataFrame, root: str) -> DataFrame:
    """Write generated files (path, content) below root: all, or none if one of them is empty, not allowed or given twice,
    or if there is none. Returns (place, bytes)."""
    spark = files.sparkSession
    wrong = violations(files)
    if not wrong.isEmpty():
        raise Refused(wrong)
    if files.isEmpty():
        raise ValueError("there is no file to write")
    absent(spark, root)
    return _write_each(files.withColumn("place", generated_path(F.col("path"))), root)


def write_mirrored(results: DataFrame, root: str) -> DataFrame:
    """Write results (source_id, json), each under its source's own path; identities must be valid and unique."""
    place = F.concat(source_id(F.col("source_id")), F.lit(".json"))
    files = results.select(F.col("source_id").alias("path"), pretty(F.col("json")).alias("content"))
    wrong = _violations(files.withColumnRenamed("path", "source_id").withColumn("path", F.col("source_id")), place)
    if not wrong.isEmpty():
        raise Refused(wrong)
    absent(results.sparkSession, root)
    return _write_each(files.withColumnRenamed("path", "source_id").withColumn("place", place), root)


def tagged(common: DataFrame, **kinds: DataFrame) -> DataFrame:
    """Rows of several kinds as one table: the common row's columns, unit_type, and the row as JSON with keys in order."""
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("unit_type"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"}).alias("result"))
        out = part if out is None else out.unionByName(part)
    head = common.limit(1).first().asDict()
    return out.select(*(F.lit(v).alias(k) for k, v in head.items()), "unit_type", "result")


def write_split(rows: DataFrame, root: str, target: str = "target") -> None:
    """One folder for each value of `target`, in one pass and one write."""
    absent(rows.sparkSession, root)
    rows.write.mode("append").partitionBy(target).parquet(root)
