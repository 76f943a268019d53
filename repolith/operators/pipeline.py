"""Imports of whole repositories and the tables they keep: index, vectors, snapshots, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.paths import suffix
from repolith.functions.scalars import grade
from repolith.operators import quality, search, snapshots, structure
from repolith.operators.parsing import parse_files

INDEX_VERSION = 1


def overwrite_projects(table: DataFrame, path: str) -> None:
    """Replaces exactly the partitions of the projects in ``table``; other projects stay as they are."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def index_signature(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.concat_ws(":", F.lit(INDEX_VERSION), F.count(F.lit(1)), F.max("chunk_id")).alias("signature"))


def save_index(passages: DataFrame, path: str) -> None:
    """Postings by project with the signature of the chunks they were made from."""
    overwrite_projects(search.postings(passages).join(index_signature(passages), "project_id"), path)


def load_index(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Postings of the projects whose chunks are still those that were indexed; the others are missing."""
    return spark.read.parquet(path).join(index_signature(chunks), ["project_id", "signature"], "left_semi").drop("signature")


def promote(table: DataFrame, root: str) -> str:
    """Writes ``table`` to a fresh folder and then points ``root`` at it: readers see the old or the new state."""
    spark = table.sparkSession
    name = uuid.uuid4().hex
    table.write.parquet(f"{root}/versions/{name}")
    spark.createDataFrame([(name,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return name


def current(spark: SparkSession, root: str) -> DataFrame:
    [row] = spark.read.parquet(f"{root}/current").collect()  # one row
    return spark.read.parquet(f"{root}/versions/{row['version']}")


def import_repository(scanned: DataFrame, project_id: int) -> dict[str, DataFrame]:
    """scan -> files, symbols, imports (resolved), issues, findings, scores and one snapshot payload."""
    path = F.col("relative_path")
    files = scanned.select(
        F.lit(project_id).cast("long").alias("project_id"), F.abs(F.xxhash64(path)).alias("file_id"), path.alias("path"), suffix(path).alias("suffix"), "line_count", "size_bytes", "content_hash", "modified_time_ns", "content"
    )
    parsed = parse_files(files)
    symbols = parsed.where("row_type = 'symbol'").drop("row_type")
    named = parsed.where("row_type = 'import'").join(files.select("file_id", F.col("path").alias("source_path"), "suffix"), "file_id")
    imports = named.select("project_id", "file_id", "source_path", "suffix", F.col("name").alias("target_module"), F.col("start_line").alias("line_number")).distinct()
    imports = structure.resolve_imports(imports, files)
    issues = parsed.where("row_type = 'issue'").select("project_id", "file_id", F.col("name").alias("message"))
    found = quality.findings(files, symbols, imports)
    scores = quality.scope_scores(found, files, symbols)
    return {"files": files.drop("content"), "parsed": parsed, "symbols": symbols, "imports": imports, "issues": issues, "findings": found, "scores": scores, "snapshot": snapshots.payload(scores, found, files)}


def markdown_report(files: DataFrame, found: DataFrame, scores: DataFrame, *, full: bool = False, limit: int = 20) -> str:
    """A report over small aggregates: totals, scores and the most urgent findings (all rules, bounded rows)."""
    [size] = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines")).collect()
    lines = ["# Repository report", "", f"- files: {size['files']}", f"- lines: {size['lines']}", "", "| scope | score | grade |", "| --- | --- | --- |"]
    graded = scores.groupBy("scope").agg(F.bround(F.avg("score")).cast("int").alias("score")).withColumn("grade", grade(F.col("score"))).orderBy("scope")
    lines += [f"| {r['scope']} | {r['score']} | {r['grade']} |" for r in graded.collect()]  # three rows
    order = [F.when(F.col("scope") == "production", 0).when(F.col("scope") == "test", 1).otherwise(2), F.when(F.col("severity") == "error", 0).otherwise(1), "rule_id", "file_id", "start_line"]
    top = found.join(files.select("file_id", "path"), "file_id").orderBy(*order).limit(limit if not full else 10 * limit)
    lines += ["", "## Findings", ""] + [f"- {r['severity']} {r['rule_id']} `{r['path']}`:{r['start_line']} ({r['metric']} > {r['threshold']})" for r in top.collect()]  # bounded
    return "\n".join(lines) + "\n"
