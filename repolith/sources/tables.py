"""Canonical tables of the engine, read from the driver's tables.

files, symbols, imports, issues, chunks, edges and vectors as DataFrames; every
other module takes and returns such DataFrames. Rows delivered twice are folded,
an older state of a file gives way to its newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.paths import parent, stem_path, suffix, unix_path
from repolith.runtime import cpu_partitions, input_bytes, read_table


def newest(df: DataFrame, key: list[str], *order) -> DataFrame:
    """One row per key: the first by ``order``."""
    line = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(line)).where("__rn = 1").drop("__rn")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "files").withColumn("line_count", F.coalesce("line_count", F.lit(0)))
    rows = newest(raw, ["file_id"], F.col("modified_time_ns").desc_nulls_last(), "content_hash", "line_count")
    path = unix_path(F.col("relative_path"))
    return rows.select("project_id", "file_id", path.alias("path"), suffix(path).alias("suffix"), "line_count", "size_bytes", "content_hash", "modified_time_ns")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, content of every file that has one."""
    raw = read_table(spark, sf_dir, "sources").where("content is not null")
    return raw.groupBy("file_id").agg(F.max("content").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "chunks")
    columns = ["project_id", "chunk_id", "file_id", "symbol_name", "kind", "start_line", "end_line", "content"]
    placed = raw.select(*columns).repartition(cpu_partitions(spark, input_bytes(raw)), "chunk_id")  # texts are tokenised next: not to be coalesced by bytes
    return newest(placed, ["chunk_id"], *[F.col(c).asc_nulls_last() for c in columns[2:]])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as the index has them: one row per chunk of a named kind."""
    # Rows that differ in their text only are one symbol: the texts are not read.
    raw = read_table(spark, sf_dir, "chunks").select("project_id", "chunk_id", "file_id", "symbol_name", "kind", "start_line", "end_line")
    rows = newest(raw, ["chunk_id"], *[F.col(c).asc_nulls_last() for c in raw.columns[2:]]).where("symbol_name is not null and kind in ('class', 'interface', 'function', 'method')")
    name = F.element_at(F.split("symbol_name", r"\."), -1)
    return rows.select("project_id", F.col("chunk_id").alias("symbol_id"), "file_id", name.alias("name"), F.col("symbol_name").alias("qualified_name"), "kind", "start_line", "end_line")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose newest parse reported a syntax error."""
    raw = read_table(spark, sf_dir, "parse_results")
    rows = newest(raw, ["file_id"], F.col("parsed_at").desc_nulls_last(), F.col("has_syntax_errors").desc_nulls_last(), "symbol_count")
    return rows.where("has_syntax_errors").select("project_id", F.col("file_id").alias("issue_id"), "file_id", F.lit("Syntax error").alias("message"))


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "parse_results")
    return newest(raw, ["file_id"], F.col("parsed_at").desc_nulls_last(), F.col("has_syntax_errors").desc_nulls_last(), "symbol_count")


_PYTHON = r"^(?:from ([\w.]+) import|import ([\w.]+))"
_SCRIPT = r"""^import .* from ["']([^"']+)["']"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import statements by line: project_id, file_id, source_path, suffix, target_module, line_number."""
    coded = files(spark, sf_dir).where(F.col("suffix").isin(".py", ".js", ".jsx", ".ts", ".tsx"))
    lines = coded.join(sources(spark, sf_dir), "file_id").select(
        "project_id", "file_id", F.col("path").alias("source_path"), "suffix", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("n", "line")
    )
    lines = lines.where(F.col("line").startswith("import ") | F.col("line").startswith("from "))
    python = F.concat(F.regexp_extract("line", _PYTHON, 1), F.regexp_extract("line", _PYTHON, 2))
    target = F.when(F.col("suffix") == ".py", python).otherwise(F.regexp_extract("line", _SCRIPT, 1))
    return lines.select("project_id", "file_id", "source_path", "suffix", target.alias("target_module"), (F.col("n") + 1).alias("line_number")).where("target_module <> ''")


def path_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import statements that follow from where files stand, in the form of ``imports``.

    Every code file imports the first file of its folder (that one the last file of
    its folder and the first one of the folder above) and the first file of its
    project: trees, hubs and small cycles whose targets exist. Names are written as
    each language has them, absolute for even file ids and for the file of the
    project, relative for the others.
    """
    code = files(spark, sf_dir).where(F.col("suffix").isin(".py", ".js", ".jsx", ".ts", ".tsx"))
    code = code.select("project_id", "file_id", F.col("path").alias("source_path"), "suffix", (F.col("suffix") == ".py").alias("py"), parent(F.col("path")).alias("dir"))
    ends = code.groupBy("project_id", "py", "dir").agg(F.min("source_path").alias("first"), F.max("source_path").alias("last"))
    placed = code.join(ends, ["project_id", "py", "dir"])
    own = placed.select("*", F.when(F.col("source_path") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("target"), F.when(F.col("source_path") == F.col("first"), 2).otherwise(1).alias("line_number"))
    above = ends.select("project_id", "py", F.col("dir").alias("up"), F.col("first").alias("target"))
    outer = placed.where("source_path = first and dir <> ''").withColumn("up", parent(F.col("dir"))).join(above, ["project_id", "py", "up"]).withColumn("line_number", F.lit(3))
    roots = code.groupBy("project_id", "py").agg(F.min("source_path").alias("target"))
    common = placed.join(roots, ["project_id", "py"]).withColumn("line_number", F.lit(4))
    stem = stem_path(F.col("target"))
    name, absolute = F.element_at(F.split(stem, "/"), -1), (F.col("file_id") % 2 == 0) | (F.col("line_number") == 4)
    dots = F.when(F.col("line_number") == 3, "..").otherwise(".")
    written = F.when(F.col("py"), F.when(absolute, F.replace(stem, F.lit("/"), F.lit("."))).otherwise(F.concat(dots, name))).otherwise(F.when(absolute, F.concat(F.lit("/"), stem)).otherwise(F.concat(dots, F.lit("/"), name)))
    rows = own.unionByName(common).where("source_path <> target").unionByName(outer.drop("up"))
    return rows.select("project_id", "file_id", "source_path", "suffix", written.alias("target_module"), "line_number")


_CYCLES = "struct<dependency:struct<cycles:array<struct<key:string,paths:array<string>>>>>"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable snapshots, each once: project_id, snapshot_id, created_at, reason, data_json."""
    raw = read_table(spark, sf_dir, "snapshots").where("data_json is not null and try_parse_json(data_json) is not null")
    return newest(raw, ["snapshot_id"], "created_at", "data_json").select("project_id", "snapshot_id", "created_at", "label", "reason", "data_json")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges that the snapshots' cycles consist of: graph_id, src, dst, line."""
    parsed = payloads(spark, sf_dir).select(F.col("snapshot_id").alias("graph_id"), F.from_json("data_json", _CYCLES).alias("j"))
    cycles = parsed.select("graph_id", F.explode("j.dependency.cycles").alias("c")).select("graph_id", F.col("c.paths").alias("paths"))
    steps = cycles.where(F.size("paths") > 0).select("graph_id", "paths", F.posexplode("paths").alias("i", "src"))
    following = F.element_at("paths", ((F.col("i") + 1) % F.size("paths") + 1).cast("int"))
    return steps.select("graph_id", "src", following.alias("dst"), (F.col("i") + 1).alias("line"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")
