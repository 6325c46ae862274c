"""A registered query: a plan over the tables of a folder and, where SQL can express it, its SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomspark.sources.tables import table

FAMILIES = ("evaluation", "contracts", "joins", "retrieval", "references", "graphs", "trees", "matching", "envelope", "markup", "order_pages")


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def shared_sql(sql: str) -> Query:
    """A query whose text both engines understand; tables stand in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})

    return Query(build, re.sub(r"\{(\w+)\}", r"\1", sql))


def collect() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in FAMILIES:
        for key, query in importlib.import_module(f"loomspark.queries.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = query
    return found
