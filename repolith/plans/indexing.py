"""Building the text index from symbols, and pages and lists around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.operators import search as R
from repolith.operators import structure as O
from repolith.plans.imports import resolved
from repolith.plans.registry import register
from repolith.plans.search import _BM25, _QUERY, index_of
from repolith.plans.structure import merged_intervals
from repolith.plans.views import with_views
from repolith.runtime import read_table
from repolith.sources import tables as T

_CODE = (".py", ".js", ".jsx", ".ts", ".tsx")
_LINES = f"""n AS (SELECT file_id, l, len(l) AS n FROM (SELECT file_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (
  SELECT file_id, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM src JOIN f USING (file_id) WHERE suffix IN {_CODE})) WHERE len(l) > 0)"""
_RANGES = """y AS (SELECT s.file_id, s.symbol_id, qualified_name, kind, greatest(1, start_line - 3) AS a, least(n, greatest(greatest(1, start_line - 3), end_line + 2)) AS b FROM s JOIN n USING (file_id) WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
o AS (SELECT * FROM y WHERE a <= b),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY a, b, symbol_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, a > 1 + max(b) OVER (PARTITION BY file_id ORDER BY a, b, symbol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM o)),
k AS (SELECT file_id, min(a) AS a, max(b) AS b FROM g GROUP BY file_id, island),
u AS (SELECT file_id, coalesce(lag(b) OVER (PARTITION BY file_id ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM k UNION ALL SELECT k.file_id, max(k.b) + 1, any_value(n) FROM k JOIN n USING (file_id) GROUP BY k.file_id),
z AS (SELECT file_id, qualified_name AS symbol_name, kind, a, CASE WHEN kind IN ('class', 'interface') THEN least(b, a + 39) ELSE b END AS b FROM o
  UNION ALL SELECT file_id, NULL, 'module', a, b FROM u WHERE a <= b UNION ALL SELECT file_id, NULL, 'file', 1, n FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file_id = n.file_id)),
w AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((b - a + 1 - 80) / 68.0) AS INTEGER) + 1))) AS j FROM z),
x AS (SELECT w.file_id, symbol_name, kind, a + 68 * j AS start_line, least(b, a + 68 * j + 79) AS last, substr(array_to_string(l[a + 68 * j : least(b, a + 68 * j + 79)], chr(10)), 1, 16000) AS content FROM w JOIN n USING (file_id))"""


def symbol_chunks(symbols: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, symbol_name, kind, start_line, end_line, content: the passages an index is made of.

    A symbol brings three lines before and two behind it, a class or interface
    only its first forty; lines of no symbol are of kind ``module``, files without
    symbols of kind ``file``. Ranges above 80 lines are cut with 12 lines shared,
    contents at 16,000 characters; blank ones are dropped. Symbols without lines
    are left out. Texts are cut inside the row of their file.
    """
    text = F.replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    split = F.split(text, "\n")
    code = files.where(F.col("suffix").isin(*_CODE)).select("file_id").join(sources, "file_id").select("file_id", split.alias("l"))
    code = code.select("file_id", F.when(F.element_at("l", -1) == "", F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l")).alias("lines")).where(F.size("lines") > 0)
    sizes = code.select("file_id", F.size("lines").alias("n"))
    a = F.greatest(F.lit(1), F.col("start_line") - 3)
    own = symbols.where("start_line is not null and end_line is not null").join(sizes, "file_id")
    own = own.select("file_id", F.col("symbol_id").alias("chunk_id"), F.col("qualified_name").alias("symbol_name"), "kind", a.alias("start_line"), F.least(F.col("n"), F.greatest(a, F.col("end_line") + 2)).alias("end_line")).where("start_line <= end_line")
    covered = merged_intervals(own)
    before = covered.select("file_id", (F.coalesce(F.lag("end_line").over(Window.partitionBy("file_id").orderBy("start_line")), F.lit(0)) + 1).alias("a"), (F.col("start_line") - 1).alias("b"))
    behind = covered.groupBy("file_id").agg((F.max("end_line") + 1).alias("a")).join(sizes.withColumnRenamed("n", "b"), "file_id")
    none = F.lit(None).cast("string").alias("symbol_name")
    modules = before.unionByName(behind).where("a <= b").select("file_id", none, F.lit("module").alias("kind"), "a", "b")
    whole = sizes.join(own.select("file_id").distinct(), "file_id", "left_anti").select("file_id", none, F.lit("file").alias("kind"), F.lit(1).alias("a"), F.col("n").alias("b"))
    cut = F.when(F.col("kind").isin("class", "interface"), F.least(F.col("end_line"), F.col("start_line") + R.CONTAINER_LINES - 1)).otherwise(F.col("end_line"))
    ranges = own.select("file_id", "symbol_name", "kind", F.col("start_line").alias("a"), cut.alias("b")).unionByName(modules).unionByName(whole)
    last = F.greatest(F.lit(0), F.ceil((F.col("b") - F.col("a") + 1 - R.CHUNK_LINES) / R.CHUNK_STEP).cast("int"))
    windows = ranges.withColumn("j", F.explode(F.sequence(F.lit(0), last))).withColumn("from", F.col("a") + F.col("j") * R.CHUNK_STEP)
    windows = windows.withColumn("to", F.least(F.col("b"), F.col("from") + R.CHUNK_LINES - 1))
    per_file = windows.groupBy("file_id").agg(F.collect_list(F.struct("symbol_name", "kind", "from", "to")).alias("w"))  # bounded by the file
    content = lambda w: F.substring(F.array_join(F.slice("lines", w["from"], w["to"] - w["from"] + 1), "\n"), 1, R.CHUNK_CHARS)
    filled = code.join(per_file, "file_id").select("file_id", F.explode(F.transform("w", lambda w: F.struct(w.alias("w"), content(w).alias("content")))).alias("x")).select("file_id", "x.w.*", "x.content")
    end = F.least(F.col("to"), F.col("from") + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))))
    return filled.where(F.trim(F.translate("content", "\n\t", "")) != "").select("file_id", "symbol_name", "kind", F.col("from").alias("start_line"), end.alias("end_line"), "content")


@register("txt01_symbol_chunks", with_views("f src c s", f"""
WITH {_LINES}, {_RANGES} SELECT file_id, symbol_name, kind, CAST(start_line AS BIGINT) AS start_line, CAST(least(last, start_line + length(content) - length(replace(content, chr(10), ''))) AS BIGINT) AS end_line, md5(content) AS digest
FROM x WHERE trim(translate(content, chr(10) || chr(9), '')) <> ''"""))
def txt01(spark: SparkSession, d: str) -> DataFrame:
    rows = symbol_chunks(T.symbols(spark, d), T.files(spark, d), T.sources(spark, d))
    return rows.select("file_id", "symbol_name", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("digest"))


@register("txt08_envelope", with_views("c fs", f"WITH {_BM25} SELECT count(*) AS total_matches, 10 AS page_size, 20 AS page_start, count(*) > 30 AS has_more, (SELECT count(*) FROM sized) AS indexed_chunks FROM r"))
def txt08(spark: SparkSession, d: str) -> DataFrame:
    """What stands around a page of search results."""
    index = index_of(spark, d)
    hits = R.search(index, _QUERY, spark=spark).agg(F.count(F.lit(1)).alias("total_matches"))
    size = spark.read.parquet(f"{index}/passages").agg(F.count(F.lit(1)).alias("indexed_chunks"))
    return hits.crossJoin(size).select("total_matches", F.lit(10).alias("page_size"), F.lit(20).alias("page_start"), (F.col("total_matches") > 30).alias("has_more"), "indexed_chunks")  # one row each


@register("win02_descendants", with_views("f", """
WITH t AS (SELECT project_id, substr(path, 5) AS rest, file_id FROM f WHERE starts_with(path, 'src/')),
d AS (SELECT project_id, true AS is_dir, string_split(rest, '/')[1] AS name, count(*) AS file_count FROM t WHERE contains(rest, '/') GROUP BY ALL UNION ALL SELECT project_id, false, rest, 1 FROM t WHERE NOT contains(rest, '/'))
SELECT *, sum(file_count) OVER (PARTITION BY project_id)::BIGINT AS descendants FROM d"""))
def win02(spark: SparkSession, d: str) -> DataFrame:
    """A folder's listing with the number of files below all of it on every row; the sum is an aggregate of its own."""
    listed = O.list_directory(T.files(spark, d), "src/").drop("file_id")
    return listed.join(listed.groupBy("project_id").agg(F.sum("file_count").alias("descendants")), "project_id")


@register("flt15_directories", r"""
WITH t AS (SELECT DISTINCT regexp_extract(relative_path, '^(.*)[/\\][^/\\]*$', 1) AS raw FROM files WHERE relative_path IS NOT NULL), v AS (SELECT raw, unnest([raw, ' ' || raw || '/', '../' || raw, raw || '/./x', raw || '\..\y']) AS given FROM t),
k AS (SELECT given, trim(replace(trim(given), '\', '/'), '/') AS directory FROM v)
SELECT DISTINCT given, CASE WHEN directory = '' THEN '' WHEN len(list_filter(string_split(directory, '/'), lambda x: x IN ('.', '..'))) > 0 THEN NULL ELSE regexp_replace(directory, '/+', '/', 'g') END AS directory FROM k""")
def flt15(spark: SparkSession, d: str) -> DataFrame:
    """Directories as given -> as looked up; null where steps would leave the tree."""
    raw = read_table(spark, d, "files").where("relative_path is not null").select(F.regexp_extract("relative_path", r"^(.*)[/\\][^/\\]*$", 1).alias("r")).distinct()
    forms = F.array(F.col("r"), F.concat(F.lit(" "), F.col("r"), F.lit("/")), F.concat(F.lit("../"), F.col("r")), F.concat(F.col("r"), F.lit("/./x")), F.concat(F.col("r"), F.lit("\\..\\y")))
    return raw.select(F.explode(forms).alias("given")).distinct().select("given", O.tree_directory(F.col("given")).alias("directory"))


@register("snp05_list_after_delete", with_views("pay", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, snapshot_id) AS age FROM pay)
SELECT project_id, snapshot_id, label, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, snapshot_id DESC) AS BIGINT) AS place FROM k WHERE age > 1"""))
def snp05(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots newest first, once each project's oldest is deleted."""
    rows = T.payloads(spark, d).select("project_id", "snapshot_id", "label", "created_at")
    oldest = rows.groupBy("project_id").agg(F.min_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))
    left = rows.join(oldest, ["project_id", "snapshot_id"], "left_anti")
    line = Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
    return left.select("project_id", "snapshot_id", "label", F.row_number().over(line).cast("long").alias("place"))


@register("qa09_dependency_supplier", with_views("pr", """
WITH k AS (SELECT project_id, file_id FROM (SELECT project_id, file_id, row_number() OVER (PARTITION BY project_id ORDER BY path, file_id) AS rn FROM f WHERE suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx')) WHERE rn <= 3),
t AS (SELECT pr.*, resolved_file_id IN (SELECT file_id FROM k) AS hit FROM pr WHERE file_id IN (SELECT file_id FROM k) OR resolved_file_id IN (SELECT file_id FROM k))
SELECT file_id, CAST(greatest(1, line_number - 1) AS BIGINT) AS start_line, target_module, CASE WHEN hit THEN 17.0 ELSE 11.0 END::DOUBLE AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY source_path, line_number, target_module) AS rn FROM t) WHERE rn <= 24"""))
def qa09(spark: SparkSession, d: str) -> DataFrame:
    """Imports that touch the target files of a question, at most 24 a project; those that lead to a target count more."""
    files = T.files(spark, d).where(F.col("suffix").isin(*_CODE))
    first = F.row_number().over(Window.partitionBy("project_id").orderBy("path", "file_id"))
    targets = files.withColumn("rn", first).where("rn <= 3").select("file_id", F.lit(True).alias("own"))
    rows = resolved(spark, d).join(targets, "file_id", "left").join(targets.select(F.col("file_id").alias("resolved_file_id"), F.lit(True).alias("hit")), "resolved_file_id", "left").where("own or hit")
    line = F.row_number().over(Window.partitionBy("project_id").orderBy("source_path", "line_number", "target_module"))
    kept = rows.withColumn("rn", line).where("rn <= 24")
    return kept.select("file_id", F.greatest(F.lit(1), F.col("line_number") - 1).cast("long").alias("start_line"), "target_module", F.when(F.coalesce("hit", F.lit(False)), 17.0).otherwise(11.0).alias("score"))
