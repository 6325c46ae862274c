"""Scans of text files, of parsed artefacts and of catalogues, with the checks that each source makes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def decode(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error) by the first encoding that fits."""
    if content is None:
        return None, None, "no content"
    for encoding in ENCODINGS:
        try:
            return bytes(content).decode(encoding), encoding, None
        except UnicodeDecodeError:
            continue
    return None, None, f"not decodable as {', '.join(ENCODINGS)}"


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content binary) -> (path, text, encoding, error). A file that cannot be decoded is a row, not a failure."""

    def run(batches):
        for pdf in batches:
            rows = [decode(x) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": pd.Series([r[0] for r in rows], dtype="object"), "encoding": pd.Series([r[1] for r in rows], dtype="object"), "error": pd.Series([r[2] for r in rows], dtype="object")})

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string, error string")


def text_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, text, encoding, error) of files below root with one of the suffixes; path is relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    kept = files.where(F.lower("path").rlike(f"({'|'.join(s.replace('.', '[.]') for s in suffixes)})$"))
    return decoded(kept.select(inside.alias("path"), "content"))


def code_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of .tsx and .ts files below root, without those in node_modules and those named *_temp."""
    found = text_files(spark, root, (".tsx", ".ts"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    kept = found.where(~F.array_contains(F.split("path", "/"), "node_modules") & ~stem.endswith("_temp"))
    return kept.select(F.col("path").alias("file"), F.col("text").alias("content"))


def artefacts(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """JSON artefacts *.<kind>.json below root, one object a file, by a schema; rows of malformed files have nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}.json").json(root)


def code_files(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """code (source_id, type, partial_types array<string>) -> the files that are neither root nor page, and the groups of
    partial types (qualified_name, source_ids, complete), which are taken before those files go."""
    parts = code.select("source_id", F.explode("partial_types").alias("qualified_name")).groupBy("qualified_name").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    groups = parts.select("qualified_name", "source_ids", (F.size("source_ids") > 1).alias("complete"))
    return code.where(F.col("type").isNull() | ~F.col("type").isin("root", "page")), groups


class Unknown(ValueError):
    """A source names what another does not have."""


def catalogue(documents: DataFrame, metadata: DataFrame, excluded: DataFrame) -> DataFrame:
    """documents (name, ..) with their metadata (name, ..) and without the excluded names. Raises Unknown if metadata names
    something that documents lack."""
    strange = metadata.join(documents, "name", "left_anti").select("name").orderBy("name").limit(20).collect()
    if strange:
        raise Unknown(f"metadata of unknown names: {', '.join(r[0] for r in strange)}")
    return documents.join(excluded.select("name"), "name", "left_anti").join(metadata, "name", "left")


def selection_violations(projects: DataFrame) -> DataFrame:
    """projects (project, pages array<string>, edges array<struct<source,target>>) -> (project, violation): without pages,
    with a page twice or no page's name, with an edge that leaves its pages, or there twice."""
    pages = F.coalesce("pages", F.array().cast("array<string>"))
    checks = F.array(
        F.when(F.size(pages) == 0, "no pages"),
        F.when(F.size(F.array_distinct(pages)) < F.size(pages), "page twice"),
        F.when(F.exists(pages, lambda x: ~F.lower(x).endswith(".xaml")), "not a page"),
        F.when(F.exists("edges", lambda e: ~F.array_contains(pages, e["source"]) | ~F.array_contains(pages, e["target"])), "edge leaves the set"),
    )
    rows = projects.select("project", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))
    twice = projects.groupBy("project").agg(F.count("*").alias("n")).where("n > 1").select("project", F.lit("project twice").alias("violation"))
    return rows.unionByName(twice)


def page_selection(projects: DataFrame, project: str) -> DataFrame:
    """The one row of a project, which must be there and without violations."""
    mine = projects.where(F.col("project") == project)
    wrong = selection_violations(mine).collect()
    if wrong:
        raise ValueError(f"{project}: {', '.join(r['violation'] for r in wrong)}")
    if mine.isEmpty():
        raise ValueError(f"no project {project}")
    return mine


def paired_pages(code: DataFrame, markup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """code (source_id, page_id: the page that it belongs to by name), markup (page_id) -> pairs (source_id, page_id) and
    violations (source_id, candidates).

    A page of exactly that identity wins; else one that differs in case only, if it is the only one. Several are a
    violation, none gives no row."""
    names = markup.select("page_id").distinct()
    exact = code.join(names, "page_id")
    rest = code.join(names, "page_id", "left_anti").select("source_id", F.lower("page_id").alias("low"))
    near = rest.join(names.select("page_id", F.lower("page_id").alias("low")), "low").groupBy("source_id").agg(F.array_sort(F.collect_set("page_id")).alias("candidates"))
    pairs = exact.select("source_id", "page_id").unionByName(near.where(F.size("candidates") == 1).select("source_id", F.col("candidates")[0].alias("page_id")))
    return pairs, near.where(F.size("candidates") > 1)
