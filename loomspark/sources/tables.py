"""Scans of the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name`; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of input for each core below which rows are dealt anew.
SPLIT_BYTES = 32 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, for costly work on each, where the input is so small that its files give fewer tasks: a file of
    one row group is one task, whatever its splits. Larger inputs stay as they are read and shuffle nothing."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def tasks(rows: DataFrame, size: int) -> int:
    """A task for each `size` bytes of input, and for each core, so that a task's work does not grow with the input."""
    held = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-held // size))


def by_key(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows dealt by a key to a task for each `size` bytes of input, so that a task's work does not grow with the input."""
    return rows.repartition(tasks(rows, size), key)
