"""Repository scans: a folder or a ZIP archive becomes a files table with contents.

The folder scan is Spark's binary-file source with a recursive lookup, so
listing and hashing are distributed. The archive is a Python data source: one
partition per slice of its central directory.

Defined results: files in ignored folders, with unknown suffixes, above the size
limit, or with a NUL in their first 4,096 bytes do not exist; a row of an empty
folder gives an empty table.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from repolith.functions.paths import suffix
from repolith.functions.scalars import LANGUAGES, TEXT_SUFFIXES, language_of

# Folders that a scan leaves out, and the limits of an import.
IGNORED_FOLDERS = [
    ".git", ".idea", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".venv", ".vscode", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv",
]
MAX_ENTRIES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 60_000, 5 << 20, 500 << 20
KNOWN_SUFFIXES = sorted({*LANGUAGES, *TEXT_SUFFIXES})


def _described(raw: DataFrame) -> DataFrame:
    """raw (relative_path, modified_time_ns, content binary) -> the files table with its text."""
    path = F.col("relative_path")
    parts = F.split(path, "/")
    ignored = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))
    kept = raw.where(~ignored & F.lower(suffix(path)).isin(KNOWN_SUFFIXES)).where(~F.hex(F.substring("content", 1, 4096)).rlike("^(?:..)*?00"))
    text = F.decode("content", "UTF-8")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)
    low = F.lower(suffix(path))
    return kept.select("relative_path", low.alias("extension"), language_of(low).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), lines.cast("int").alias("line_count"), F.sha2("content", 256).alias("content_hash"), "modified_time_ns", text.alias("content"))


def scan_folder(spark: SparkSession, root: str, *, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """relative_path, extension, language, size_bytes, line_count, content_hash, modified_time_ns, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_file_bytes)
    base = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit(base), F.lit(""))
    return _described(raw.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("relative_path"), (F.unix_micros("modificationTime") * 1000).alias("modified_time_ns"), "content"))


def checked_entries(archive: zipfile.ZipFile, *, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL_BYTES) -> list[str]:
    """Names of an archive's files; raises ValueError for an archive that is not safe to read."""
    entries = archive.infolist()
    if not entries:
        raise ValueError("the archive is empty")
    if len(entries) > max_entries:
        raise ValueError("the archive has too many entries")
    if sum(e.file_size for e in entries) > max_total:
        raise ValueError("the archive is too large")
    seen: set[str] = set()
    names = []
    for entry in entries:
        name = entry.filename.replace("\\", "/")
        if name.startswith("/") or ":" in name.split("/")[0] or ".." in name.split("/"):
            raise ValueError(f"unsafe path: {name}")
        if entry.flag_bits & 1:
            raise ValueError("the archive is encrypted")
        if entry.is_dir() or entry.external_attr >> 16 & 0o170000 == 0o120000:
            continue
        if name.casefold() in seen:
            raise ValueError(f"two entries differ in case only: {name}")
        seen.add(name.casefold())
        names.append(entry.filename)
    return names


def collapsed_root(names: list[str]) -> str:
    """The single folder that holds everything, with its slash; empty if there is none."""
    roots = {n.split("/")[0] for n in names if "/" in n}
    return f"{roots.pop()}/" if len(roots) == 1 and all("/" in n for n in names) else ""


class _Slice(InputPartition):
    def __init__(self, names: list[str], root: str) -> None:
        self.names, self.root = names, root


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.slices = int(options.get("slices", 8))
        self.limit = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as archive:
            names = checked_entries(archive)
        return [_Slice(names[i :: self.slices], collapsed_root(names)) for i in range(min(self.slices, max(1, len(names))))]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as archive:
            for name in partition.names:
                if archive.getinfo(name).file_size <= self.limit:
                    yield name.replace("\\", "/").removeprefix(partition.root), 0, archive.read(name)


class ArchiveSource(DataSource):
    """``spark.read.format("repolith_zip").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "repolith_zip"

    def schema(self) -> str:
        return "relative_path string, modified_time_ns bigint, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options)


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """A ZIP archive as a files table; a single root folder is taken off."""
    spark.dataSource.register(ArchiveSource)
    return _described(spark.read.format("repolith_zip").option("path", path).load())


def admitted_uploads(files: DataFrame, *, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """files (relative_path, size_bytes) of an upload: safe relative paths only, within a byte budget in path order."""
    safe = files.where(~F.col("relative_path").startswith("/") & ~F.col("relative_path").rlike(r"(^|/)\.\.(/|$)") & ~F.col("relative_path").rlike(r"^[A-Za-z]:") & (F.col("size_bytes") <= MAX_FILE_BYTES))
    upto = F.sum("size_bytes").over(Window.partitionBy(F.lit(1)).orderBy("relative_path").rowsBetween(Window.unboundedPreceding, 0))  # one upload, 20,000 files at most
    return safe.withColumn("upto", upto).where(F.col("upto") <= max_total).drop("upto")
