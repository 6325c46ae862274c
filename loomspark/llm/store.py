"""Intermediate tables in the cluster's shared checkpoint folder.

A table that is read again, or that ends a long lineage, is written once as Parquet under
``spark.checkpoint.dir`` and read back, so that a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only on one machine (tests), where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """A folder of intermediate tables that belongs to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{folder(spark)}/loomspark/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._hadoop_path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop_path)
        self._fs.deleteOnExit(self._hadoop_path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: its lineage ends here, and its shuffle files can go."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def save_with(self, df: DataFrame, name: str, measures: list[Column]) -> tuple[DataFrame, dict]:
        """save, and aggregates of df that are measured while it is written."""
        seen = Observation()
        return self.save(df.observe(seen, *measures), name).select(*df.columns), seen.get

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self._fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nobody holds any more. It does so when the driver
        collects its garbage, which on a driver with a large heap may be long after a disk is full."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def only(self, name: str) -> None:
        """Delete all tables but one."""
        for status in self._fs.listStatus(self._hadoop_path):
            if status.getPath().getName() != name:
                self._fs.delete(status.getPath(), True)
