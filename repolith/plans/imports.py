"""Import resolution and the dependency graph that follows from it, on imports whose targets exist.

The import lines of the test tables name no file of their project; these queries
take the statements that follow from the paths instead (``tables.path_imports``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import graph as G
from repolith.operators import structure as O
from repolith.plans.registry import register
from repolith.plans.views import with_views
from repolith.runtime import shared_table
from repolith.sources import tables as T


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return O.resolve_imports(T.path_imports(spark, d), T.files(spark, d))


_EDGES: dict[tuple[str, str], DataFrame] = {}  # (application, input) -> the edge table, written once


def edges(spark: SparkSession, d: str) -> DataFrame:
    """graph_id (project), src, dst (paths), line."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _EDGES:
        _EDGES[key] = shared_table(_derived_edges(spark, d))
    return _EDGES[key]


def _derived_edges(spark: SparkSession, d: str) -> DataFrame:
    targets = T.files(spark, d).select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("dst"))
    rows = resolved(spark, d).where("resolved_file_id is not null").join(targets, "resolved_file_id")
    return rows.select(F.col("project_id").alias("graph_id"), F.col("source_path").alias("src"), "dst", F.col("line_number").cast("long").alias("line"))


@register("prs06_path_imports", with_views("pr", "SELECT project_id, file_id, target_module, CAST(line_number AS BIGINT) AS line_number, coalesce(resolved_file_id, -1) AS resolved_file_id FROM pr"))
def prs06(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("project_id", "file_id", "target_module", F.col("line_number").cast("long").alias("line_number"), F.coalesce("resolved_file_id", F.lit(-1)).alias("resolved_file_id"))


@register("jon03_path_targets", with_views("pe", "SELECT graph_id AS project_id, src AS source_path, dst AS target_path, line AS line_number FROM pe"))
def jon03(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(F.col("graph_id").alias("project_id"), F.col("src").alias("source_path"), F.col("dst").alias("target_path"), F.col("line").alias("line_number"))


@register("jon04_path_membership", with_views("pr", """
WITH k AS (SELECT file_id FROM f WHERE starts_with(path, 'app/services/')) SELECT file_id, target_module, CAST(line_number AS BIGINT) AS line_number FROM pr WHERE file_id IN (SELECT file_id FROM k) OR resolved_file_id IN (SELECT file_id FROM k)"""))
def jon04(spark: SparkSession, d: str) -> DataFrame:
    """Imports whose source or target is in a set of files."""
    wanted = T.files(spark, d).where(F.col("path").startswith("app/services/")).select("file_id")
    as_target = wanted.select(F.col("file_id").alias("resolved_file_id"), F.lit(True).alias("t"))
    as_source = wanted.withColumn("s", F.lit(True))
    rows = resolved(spark, d).join(as_source, "file_id", "left").join(as_target, "resolved_file_id", "left").where("s or t")
    return rows.select("file_id", "target_module", F.col("line_number").cast("long").alias("line_number"))


_CLOSURE = """d AS (SELECT DISTINCT graph_id, src, dst FROM pe),
r AS (SELECT graph_id, src, dst FROM d UNION SELECT r.graph_id, r.src, d.dst FROM r JOIN d ON d.graph_id = r.graph_id AND d.src = r.dst),
scc AS (SELECT a.graph_id, a.src AS node, min(b.src) AS component FROM r a JOIN r b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)"""


@register("grf01_path_components", with_views("pe", f"WITH {_CLOSURE} SELECT graph_id, component, node FROM scc", recursive=True))
def grf01(spark: SparkSession, d: str) -> DataFrame:
    return G.strongly_connected(edges(spark, d))


@register("grf01_path_components_in_rounds", with_views("pe", f"WITH {_CLOSURE} SELECT graph_id, component, node FROM scc", recursive=True))
def grf01_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by the rounds that graphs too large for a task take."""
    return G.strongly_connected(edges(spark, d), grouped_edges=0)


@register("agg06_path_degrees", with_views("pe", """
WITH dd AS (SELECT DISTINCT graph_id, src, dst FROM pe), o AS (SELECT graph_id, src AS node, count(*) AS out_degree FROM dd GROUP BY ALL), i AS (SELECT graph_id, dst AS node, count(*) AS in_degree FROM dd GROUP BY ALL)
SELECT graph_id, node, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM o FULL JOIN i USING (graph_id, node)"""))
def agg06(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(spark, d))


@register("imp05_path_callers", with_views("pe", """
WITH dd AS (SELECT DISTINCT graph_id, src, dst FROM pe WHERE src <> dst)
SELECT DISTINCT a.graph_id, a.dst AS node, b.src AS caller FROM dd a JOIN dd b ON b.graph_id = a.graph_id AND b.dst = a.src WHERE b.src <> a.dst AND NOT EXISTS (SELECT 1 FROM dd x WHERE x.graph_id = a.graph_id AND x.dst = a.dst AND x.src = b.src)"""))
def imp05(spark: SparkSession, d: str) -> DataFrame:
    """Callers of callers, through hubs and chains."""
    return G.two_hops(edges(spark, d)).select("graph_id", "node", "caller")


@register("qlt06_path_fan_out", with_views("pe fs", """
WITH k AS (SELECT graph_id AS project_id, src AS path, count(DISTINCT dst) AS metric FROM pe GROUP BY ALL)
SELECT k.project_id, k.path, metric, fs.scope FROM k JOIN fs ON fs.project_id = k.project_id AND fs.path = k.path WHERE metric >= 2"""))
def qlt06(spark: SparkSession, d: str) -> DataFrame:
    """Files by the number of files they depend on, from two on, with their scope."""
    fan = edges(spark, d).select(F.col("graph_id").alias("project_id"), F.col("src").alias("path"), "dst").distinct().groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("metric"))
    return fan.where("metric >= 2").withColumn("scope", S.code_scope(F.col("path")))
