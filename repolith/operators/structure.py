"""Structure: listings, summaries, paging, directory trees, module index and import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions.scalars import PARSED_SUFFIXES


def page(df: DataFrame, order: list, *, offset: int, limit: int) -> DataFrame:
    """A page of a listing with the envelope's numbers on every row: total, has_more.

    The total is an aggregate of its own and joined as one row, so the listing
    is never drawn into a single partition; the page itself is a distributed
    top-k (offset + limit rows per task).
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    n = F.least(F.lit(limit).cast("long"), F.greatest(F.col("total") - offset, F.lit(0).cast("long")))
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset) + n < F.col("total"))  # one row


def structure_summary(symbols: DataFrame, imports: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per project, zero where a table has no row of it."""
    s = symbols.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("kind").isin("class", "interface")).alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions")
    )
    m = imports.groupBy("project_id").agg(F.count(F.lit(1)).alias("imports"), F.count_if(F.col("resolved_file_id").isNotNull()).alias("resolved"))
    i = issues.groupBy("project_id").agg(F.count(F.lit(1)).alias("issues"))
    return s.join(m, "project_id", "full").join(i, "project_id", "full").na.fill(0, ["symbols", "classes", "functions", "imports", "resolved", "issues"])


def list_directory(files: DataFrame, directory: Column | str = "") -> DataFrame:
    """One level below ``directory``: folders with their numbers of files below, then files."""
    prefix = F.lit(directory) if isinstance(directory, str) else directory
    rest = F.substr(F.col("path"), F.length(prefix) + 1)
    below = files.where(F.col("path").startswith(prefix)).withColumn("rest", rest)
    folders = below.where(F.col("rest").contains("/")).groupBy("project_id", F.substring_index("rest", "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("file_count"))
    leaves = below.where(~F.col("rest").contains("/")).select("project_id", F.col("rest").alias("name"), F.lit(1).cast("long").alias("file_count"), "file_id")
    return folders.withColumn("is_dir", F.lit(True)).unionByName(leaves.withColumn("is_dir", F.lit(False)), allowMissingColumns=True)


def tree_directory(given: Column) -> Column:
    """A directory as it is looked up: slashes turned, none at the ends; null if a step of it is ``.`` or ``..``."""
    steps = F.filter(F.split(F.replace(F.trim(given), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.when(~F.exists(steps, lambda p: p.isin(".", "..")), F.array_join(steps, "/"))


def python_module_index(files: DataFrame) -> DataFrame:
    """alias -> file per project; a leading source folder may be left out, ambiguous aliases are dropped."""
    base = F.regexp_replace(F.replace(P.stem_path(F.col("path")), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")
    short = F.when(base.rlike(r"^(?:src|backend|server|python)\."), F.regexp_replace(base, r"^[^.]+\.", ""))
    aliases = F.filter(F.array_distinct(F.array(base, short)), lambda a: a.isNotNull() & (a != ""))
    rows = files.where("suffix = '.py'").select("project_id", "file_id", F.explode(aliases).alias("alias"))
    return rows.groupBy("project_id", "alias").agg(F.min("file_id").alias("file_id"), F.max("file_id").alias("other")).where("file_id = other").drop("other")


def javascript_candidates(path: Column) -> Column:
    """Files that an extension-less or directory import may mean, in order of preference."""
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.d.ts"]
    return F.array(*[F.concat(path, F.lit(e)) for e in ends])


def first_match(candidates: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """Of ordered candidates (``candidate``, ``priority``) the first that is a file of the project."""
    known = files.select("project_id", F.col("path").alias("candidate"), F.col("file_id").alias("resolved_file_id"))
    hits = candidates.join(known, ["project_id", "candidate"])
    return hits.groupBy(*key).agg(F.min_by("resolved_file_id", F.struct("priority", "resolved_file_id")).alias("resolved_file_id"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``resolved_file_id`` (null where no file of the project is meant).

    Python names go through the module index (a relative name by its leading
    dots, an absolute one as it stands); JavaScript names are joined as paths,
    relative ones below the importer's folder, others below the root.
    """
    key = ["project_id", "file_id", "target_module", "line_number"]
    index = python_module_index(files).select("project_id", F.col("alias").alias("name"), F.col("file_id").alias("resolved_file_id"))
    python = imports.where("suffix = '.py'")
    level = F.length(F.regexp_extract("target_module", r"^(\.*)", 1))
    folder = F.split(P.parent(F.col("source_path")), "/")
    base = F.concat_ws(".", F.slice(folder, F.lit(1), F.greatest(F.size(folder) - level + 1, F.lit(0))))
    rest = F.regexp_replace("target_module", r"^\.+", "")
    name = F.when(level > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit("")))).otherwise(F.col("target_module"))
    python_hits = python.withColumn("name", name).join(index, ["project_id", "name"]).select(*key, "resolved_file_id")
    script = imports.where(F.col("suffix").isin(".js", ".jsx", ".ts", ".tsx"))
    relative = F.col("target_module").rlike(r"^\.\.?/")
    joined = F.when(relative, P.normalised(F.concat_ws("/", F.nullif(P.parent(F.col("source_path")), F.lit("")), F.col("target_module")))).otherwise(F.ltrim(F.col("target_module"), F.lit("/")))
    candidates = script.withColumn("base", joined).where(~F.col("base").startswith("../")).select(*key, F.posexplode(javascript_candidates(F.col("base"))).alias("priority", "candidate"))
    hits = python_hits.unionByName(first_match(candidates, key, files)).groupBy(*key).agg(F.min("resolved_file_id").alias("resolved_file_id"))
    return imports.join(hits, key, "left")


def module_roots(files: DataFrame) -> DataFrame:
    """First path segments of each project and their stems, lower case."""
    first = F.lower(F.substring_index("path", "/", 1))
    return files.select("project_id", F.explode(F.array(first, F.regexp_replace(first, r"\.[^.]*$", ""))).alias("root")).where("root <> ''").distinct()


# Words an unresolved import cannot be external under.
def classify_unresolved(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """imports with ``target_class``: likely_external or unresolved."""
    low = F.lower(F.trim(F.col("target_module")))
    python = F.substring_index(F.regexp_replace(low, r"^\.+", ""), ".", 1)
    root = F.when(F.col("suffix") == ".py", python).otherwise(P.package_root(low))
    named = imports.withColumn("root", root)
    marked = named.join(roots.withColumn("own", F.lit(True)), ["project_id", "root"], "left")
    script = F.col("suffix").isin(".js", ".jsx", ".ts", ".tsx")
    kind = (
        F.when((low == "") | low.rlike(r"^[./]"), "unresolved")
        .when(script & low.startswith("node:"), "likely_external")
        .when(script & low.rlike(r"^[@~]/"), "unresolved")
        .when(F.coalesce("own", F.lit(False)) | (F.col("root") == ""), "unresolved")
        .otherwise("likely_external")
    )
    return marked.withColumn("target_class", kind).drop("own", "root")


def primary_language(files: DataFrame, language: Column) -> DataFrame:
    """Language with most lines per project; ties go to the one whose first path comes first."""
    sums = files.withColumn("language", language).where("language is not null").groupBy("project_id", "language").agg(F.sum("line_count").alias("lines"), F.min("path").alias("first_path"))
    best = Window.partitionBy("project_id").orderBy(F.col("lines").desc(), "first_path")
    return sums.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("project_id", F.col("language").alias("primary_language"), "lines")


def supported(suffix: Column) -> Column:
    return suffix.isin(PARSED_SUFFIXES)
