"""Source files that do not parse (problem 3).

Every newest text of a file is parsed by a generalised LL recogniser with a
graph-structured stack (``gll``) in the dialect that the suffix of its path
promises, together with all dialects that read the same tokens: they share one
grammar and one graph-structured stack, whose descriptors carry the dialects they
hold for. What the promised dialect refuses is also read in those whose tokens
differ, so that a wrong extension (``accepted_by`` another dialect) can be told
from a text that every dialect refuses. Nothing is taken from the flag that an older parser left.

Defined results: an empty file parses; a null content gives a null flag and is
no case; paths with backslashes count like others; rows without a file_id are
left out; of rows that repeat a file_id every different content is parsed and
one refusal suffices; a text that cannot be read within the bounds below is
parsed all the same, there is no size limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm import python_syntax, script_syntax
from repolith.runtime import cpu_partitions, input_bytes

#: suffix -> (dialect, language)
DIALECTS = {".py": ("py", "Python"), ".js": ("js", "JavaScript"), ".jsx": ("jsx", "JavaScript"), ".ts": ("ts", "TypeScript"), ".tsx": ("tsx", "TypeScript")}


@lru_cache(maxsize=256)
def judged(text: str, dialect: str) -> tuple[list[str], int | None]:
    """(dialects that derive ``text``, line of the error in ``dialect``: 0 where it has no place, None if it parses)."""
    if dialect == "py":
        if python_syntax.parses(text):
            return ["py"], None
        return script_syntax.accepting(text), 0
    good, offset = script_syntax.accepted_by(text, dialect)
    if offset is None:
        return good, None
    return good + (["py"] if python_syntax.parses(text) else []), text.count("\n", 0, offset) + 1


def accepts(text: str, dialect: str) -> bool:
    """Whether ``text`` is derived by the grammar of ``dialect``."""
    return dialect in judged(text, dialect)[0]


def latest_files(files: DataFrame) -> DataFrame:
    """project_id, file_id, relative_path, extension, line_count: the newest row of each file, slashes turned."""
    newest = F.struct(F.col("modified_time_ns").alias("t"), F.col("relative_path").alias("p"), F.col("line_count").alias("l"))
    row = F.struct("project_id", "relative_path", "line_count")
    return (
        files.where("file_id is not null and relative_path is not null")
        .groupBy(F.col("file_id").cast("long").alias("file_id"))
        .agg(F.max_by(row, newest).alias("r"))
        .select(F.col("r.project_id").cast("long").alias("project_id"), "file_id", F.translate("r.relative_path", "\\", "/").alias("relative_path"), F.col("r.line_count").alias("line_count"))
        .withColumn("suffix", F.regexp_extract("relative_path", r"(\.[^./]*)$", 1))
    )


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags, others, lines = [], [], []
        for dialect, text in zip(batch.column("dialect").to_pylist(), batch.column("content").to_pylist()):
            good, line = judged(text, dialect) if text is not None else ([], None)
            flags.append(None if text is None else dialect not in good)
            others.append(good if line is not None else [])
            lines.append(line or None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("project_id", "file_id", "relative_path", "dialect")), pa.array(flags, pa.bool_()), pa.array(lines, pa.int32()), pa.array(others, pa.list_(pa.string()))],
            names=["project_id", "file_id", "relative_path", "dialect", "has_syntax_errors", "error_line", "accepted_by"],
        )


_DDL = "project_id bigint, file_id bigint, relative_path string, dialect string, has_syntax_errors boolean, error_line int, accepted_by array<string>"


def check_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """project_id, file_id, relative_path, dialect, has_syntax_errors, error_line, accepted_by of every file with a suffix above."""
    dialect = F.create_map(*[x for suffix, (d, _) in DIALECTS.items() for x in (F.lit(suffix), F.lit(d))])
    wanted = latest_files(files).where(F.col("suffix").isin(list(DIALECTS))).select("project_id", "file_id", "relative_path", dialect[F.col("suffix")].alias("dialect"))
    texts = sources.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.col("content").cast("string").alias("content"))
    # Both sides are placed by the join key once, in as many partitions as parsing wants.
    n = cpu_partitions(files.sparkSession, input_bytes(sources))
    joined = wanted.repartition(n, "file_id").join(texts.repartition(n, "file_id").hint("merge"), "file_id").select("project_id", "file_id", "relative_path", "dialect", "content")
    checked = joined.mapInArrow(_check, _DDL)
    # Repeated rows of a file stand in one partition already; a refusal wins over an acceptance, that over null.
    order = Window.partitionBy("file_id").orderBy(F.col("has_syntax_errors").desc_nulls_last(), "error_line")
    return checked.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def broken_files(checked: DataFrame) -> DataFrame:
    return checked.where("has_syntax_errors").select("file_id")


def error_rates(checked: DataFrame) -> DataFrame:
    """project_id, language, files, broken_files, rate over the files that could be read."""
    language = F.create_map(*[F.lit(x) for d, name in DIALECTS.values() for x in (d, name)])
    known = checked.where("has_syntax_errors is not null")
    grouped = known.groupBy("project_id", language[F.col("dialect")].alias("language"))
    return grouped.agg(F.count(F.lit(1)).alias("files"), F.count_if("has_syntax_errors").alias("broken_files")).withColumn("rate", F.col("broken_files") / F.col("files"))
