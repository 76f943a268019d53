"""Queries over dependency graphs, quality rules and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import graph as G
from repolith.operators import quality as Q
from repolith.plans.registry import register
from repolith.plans.views import with_views
from repolith.sources import tables as T

_CLOSURE = """d AS (SELECT DISTINCT graph_id, src, dst FROM e),
r AS (SELECT graph_id, src, dst FROM d UNION SELECT r.graph_id, r.src, d.dst FROM r JOIN d ON d.graph_id = r.graph_id AND d.src = r.dst),
scc AS (SELECT a.graph_id, a.src AS node, min(b.src) AS component FROM r a JOIN r b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)"""


@register("grf01_scc", with_views("e", f"WITH {_CLOSURE} SELECT graph_id, component, node FROM scc", recursive=True))
def grf01(spark: SparkSession, d: str) -> DataFrame:
    return G.strongly_connected(T.edges(spark, d))


@register("srt14_cycle_order", with_views("e", f"""
WITH {_CLOSURE}, g AS (SELECT graph_id, component, count(*) AS size, array_to_string(list_sort(list(node)), '|') AS members FROM scc GROUP BY ALL)
SELECT graph_id, members, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY size DESC, members) AS BIGINT) AS place FROM g""", recursive=True))
def srt14(spark: SparkSession, d: str) -> DataFrame:
    groups = G.strongly_connected(T.edges(spark, d)).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("members"))
    line = Window.partitionBy("graph_id").orderBy(F.col("size").desc(), "members")
    return groups.select("graph_id", "members", F.row_number().over(line).cast("long").alias("place"))


@register("agg05_edges", with_views("e", "SELECT graph_id, src, dst, count(*) AS import_count, array_to_string(list_sort(list(line)), ',') AS lines FROM e GROUP BY ALL"))
def agg05(spark: SparkSession, d: str) -> DataFrame:
    return G.distinct_edges(T.edges(spark, d)).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


_DEGREES = """dd AS (SELECT DISTINCT graph_id, src, dst FROM e), n AS (SELECT graph_id, src AS node FROM dd UNION SELECT graph_id, dst FROM dd),
deg AS (SELECT n.graph_id, n.node, (SELECT count(*) FROM dd WHERE dd.graph_id = n.graph_id AND dd.dst = n.node) AS in_degree, (SELECT count(*) FROM dd WHERE dd.graph_id = n.graph_id AND dd.src = n.node) AS out_degree FROM n)"""


@register("agg06_degrees", with_views("e", f"WITH {_DEGREES} SELECT * FROM deg"))
def agg06(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(T.edges(spark, d))


@register("srt09_graph_ranking", with_views("e", f"""
WITH {_DEGREES}, {_CLOSURE}, k AS (SELECT deg.*, in_degree + out_degree AS degree, scc.node IS NOT NULL AS in_cycle FROM deg LEFT JOIN scc USING (graph_id, node))
SELECT graph_id, node, degree, in_cycle, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY in_cycle DESC, degree DESC, node) AS rn FROM k) WHERE rn <= 40""", recursive=True))
def srt09(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    ranked = G.ranking(edges, G.strongly_connected(edges))
    line = Window.partitionBy("graph_id").orderBy(F.col("in_cycle").desc(), F.col("degree").desc(), "node")
    return ranked.withColumn("place", F.row_number().over(line).cast("long")).where("place <= 40").select("graph_id", "node", "degree", "in_cycle", "place")


@register("grf03_graph_view", with_views("e", f"""
WITH {_DEGREES}, v AS (SELECT graph_id, node FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY in_degree + out_degree DESC, node) AS rn FROM deg) WHERE rn <= 5)
SELECT dd.* FROM dd WHERE EXISTS (SELECT 1 FROM v WHERE v.graph_id = dd.graph_id AND v.node = dd.src) AND EXISTS (SELECT 1 FROM v WHERE v.graph_id = dd.graph_id AND v.node = dd.dst)"""))
def grf03(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    line = Window.partitionBy("graph_id").orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "node")
    seen = G.degrees(edges).withColumn("rn", F.row_number().over(line)).where("rn <= 5").select("graph_id", "node")
    once = edges.select("graph_id", "src", "dst").distinct()
    return once.join(seen.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").join(seen.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


@register("grf04_cyclic_edges", with_views("e", f"WITH {_CLOSURE} SELECT d.graph_id, d.src, d.dst, coalesce(a.component = b.component, false) AS cyclic FROM d LEFT JOIN scc a ON a.graph_id = d.graph_id AND a.node = d.src LEFT JOIN scc b ON b.graph_id = d.graph_id AND b.node = d.dst", recursive=True))
def grf04(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    scc = G.strongly_connected(edges)
    side = lambda end: scc.select("graph_id", F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    both = edges.select("graph_id", "src", "dst").distinct().join(side("src"), ["graph_id", "src"], "left").join(side("dst"), ["graph_id", "dst"], "left")
    return both.select("graph_id", "src", "dst", F.coalesce(F.col("src_component") == F.col("dst_component"), F.lit(False)).alias("cyclic"))


_TWO = """dd AS (SELECT DISTINCT graph_id, src, dst FROM e WHERE src <> dst), two AS (SELECT DISTINCT a.graph_id, a.dst AS node, b.src AS caller FROM dd a JOIN dd b ON a.graph_id = b.graph_id AND b.dst = a.src
  WHERE b.src <> a.dst AND NOT EXISTS (SELECT 1 FROM dd x WHERE x.graph_id = a.graph_id AND x.dst = a.dst AND x.src = b.src))"""


@register("imp05_indirect_callers", with_views("e", f"WITH {_TWO} SELECT * FROM two"))
def imp05(spark: SparkSession, d: str) -> DataFrame:
    return G.two_hops(T.edges(spark, d))


@register("imp03_incoming", with_views("e", "SELECT graph_id, dst AS node, src AS caller, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM e WHERE src <> dst GROUP BY ALL"))
def imp03(spark: SparkSession, d: str) -> DataFrame:
    rows = T.edges(spark, d).where("src <> dst").groupBy("graph_id", F.col("dst").alias("node"), F.col("src").alias("caller"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set("line")).cast("array<string>"), ",").alias("lines"))


@register("imp04_outgoing", with_views("e", "SELECT graph_id, src AS node, count(DISTINCT dst) AS dependencies FROM e WHERE src <> dst GROUP BY ALL"))
def imp04(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(spark, d).where("src <> dst").groupBy("graph_id", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("dependencies"))


@register("imp06_merge_relations", with_views("e", "SELECT graph_id, dst AS node, CAST(count(DISTINCT src) AS BIGINT) AS files, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM e GROUP BY ALL"))
def imp06(spark: SparkSession, d: str) -> DataFrame:
    rows = T.edges(spark, d).groupBy("graph_id", F.col("dst").alias("node"))
    return rows.agg(F.count_distinct("src").alias("files"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("line"))))).cast("array<string>"), ",").alias("lines"))


_POINTS = "CASE WHEN {x} <= 0 THEN 0 ELSE greatest(1, CAST(round_even({m} * ln(1 + least(CAST({x} AS DOUBLE), {r}.0)) / ln(1 + {r}.0), 0) AS INTEGER)) END"
_RISK_SQL = f"""WITH {_DEGREES}, {_CLOSURE}, dz AS (SELECT DISTINCT graph_id, src, dst FROM e WHERE src <> dst),
two AS (SELECT DISTINCT a.graph_id, a.dst AS node, b.src AS caller FROM dz a JOIN dz b ON a.graph_id = b.graph_id AND b.dst = a.src WHERE b.src <> a.dst AND NOT EXISTS (SELECT 1 FROM dz x WHERE x.graph_id = a.graph_id AND x.dst = a.dst AND x.src = b.src)),
t AS (SELECT n.graph_id, n.node, (SELECT count(*) FROM dz WHERE dz.graph_id = n.graph_id AND dz.dst = n.node) AS callers, (SELECT count(*) FROM dz WHERE dz.graph_id = n.graph_id AND dz.src = n.node) AS deps,
  (SELECT count(*) FROM two WHERE two.graph_id = n.graph_id AND two.node = n.node) AS indirect, (SELECT count(*) FROM n x WHERE x.graph_id = n.graph_id) AS files, EXISTS (SELECT 1 FROM scc WHERE scc.graph_id = n.graph_id AND scc.node = n.node) AS cyclic,
  list_has_any(regexp_split_to_array(lower(n.node), '[/._-]+'), ['api', 'routes', 'route', 'controller', 'endpoint']) AS api, list_has_any(regexp_split_to_array(lower(n.node), '[/._-]+'), ['db', 'queries', 'models', 'model', 'database']) AS db FROM n),
u AS (SELECT *, 8 + {_POINTS.format(x='callers', m=20, r=8)} + {_POINTS.format(x='deps', m=10, r=6)} + {_POINTS.format(x='indirect', m=10, r=8)}
  + {_POINTS.format(x='round(100.0 * (callers + indirect) / greatest(1, files), 2)', m=12, r=5)} + CASE WHEN cyclic THEN 15 ELSE 0 END + CASE WHEN api THEN 8 ELSE 0 END + CASE WHEN db THEN 10 ELSE 0 END + 8 AS s FROM t)
SELECT graph_id, node, CAST(greatest(0, least(100, s)) AS BIGINT) AS score, CASE WHEN s >= 65 THEN 'high' WHEN s >= 35 THEN 'medium' ELSE 'low' END AS level FROM u"""


@register("imp07_risk_score", with_views("e", _RISK_SQL, recursive=True))
def imp07(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    return Q.risk(edges, G.strongly_connected(edges)).select("graph_id", "node", F.col("score").cast("long").alias("score"), "level")


@register("qlt02_large_files", with_views("fs", "SELECT file_id, CASE WHEN line_count > 300 THEN 'error' ELSE 'warning' END AS severity, CAST(line_count AS BIGINT) AS metric FROM fs WHERE line_count > 100"))
def qlt02(spark: SparkSession, d: str) -> DataFrame:
    return Q.large_files(T.files(spark, d), threshold=100).select("file_id", "severity", F.col("metric").cast("long").alias("metric"))


_FINDINGS = """fnd AS (
  SELECT f.project_id, fs.scope, 'LARGE_FILE' AS rule_id, f.file_id, 1 AS start_line, CASE WHEN f.line_count > 300 THEN 'error' ELSE 'warning' END AS severity, f.line_count AS metric FROM f JOIN fs USING (file_id) WHERE f.line_count > 100
  UNION ALL SELECT s.project_id, fs.scope, 'LONG_FUNCTION', s.file_id, s.start_line, CASE WHEN s.end_line - s.start_line + 1 > 40 THEN 'error' ELSE 'warning' END, s.end_line - s.start_line + 1 FROM s JOIN fs USING (file_id) WHERE s.kind IN ('function', 'method') AND s.end_line - s.start_line + 1 > 20
  UNION ALL SELECT s.project_id, fs.scope, 'LARGE_CLASS', s.file_id, s.start_line, CASE WHEN s.end_line - s.start_line + 1 > 80 THEN 'error' ELSE 'warning' END, s.end_line - s.start_line + 1 FROM s JOIN fs USING (file_id) WHERE s.kind IN ('class', 'interface') AND s.end_line - s.start_line + 1 > 40
  UNION ALL SELECT m.project_id, any_value(fs.scope), 'TOO_MANY_IMPORTS', m.file_id, min(m.line_number), CASE WHEN count(*) > 8 THEN 'error' ELSE 'warning' END, count(*) FROM m JOIN fs USING (file_id) GROUP BY m.project_id, m.file_id HAVING count(*) > 4)"""


@register("qlt01_findings", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT project_id, scope, rule_id, file_id, CAST(start_line AS BIGINT) AS start_line, severity, CAST(metric AS BIGINT) AS metric FROM fnd"))
def qlt01(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d)
    return rows.select("project_id", "scope", "rule_id", "file_id", F.col("start_line").cast("long").alias("start_line"), "severity", F.col("metric").cast("long").alias("metric"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """The rules with thresholds that the test tables reach."""
    return Q.findings(T.files(spark, d), T.symbols(spark, d), T.imports(spark, d), file_lines=100, function_lines=20, class_lines=40, imports_per_file=4)


@register("agg09_severity_counts", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT rule_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM fnd GROUP BY rule_id"))
def agg09(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("rule_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@register("agg10_scope_pivot", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT scope, count_if(severity = 'error') AS error, count_if(severity = 'warning') AS warning FROM fnd GROUP BY scope"))
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("scope").pivot("severity", ["error", "warning"]).count().na.fill(0)


@register("agg11_risk_modules", with_views("f fs c s m", f"""
WITH {_FINDINGS} SELECT * FROM (SELECT scope, file_id, CAST(sum(CASE severity WHEN 'error' THEN 8 WHEN 'warning' THEN 3 ELSE 1 END) AS BIGINT) AS score, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules
FROM fnd GROUP BY scope, file_id) ORDER BY CASE scope WHEN 'production' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, score DESC, file_id LIMIT 100"""))
def agg11(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("severity") == "error", 8).when(F.col("severity") == "warning", 3).otherwise(1)
    rows = findings(spark, d).groupBy("scope", "file_id").agg(F.sum(weight).alias("score"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))
    scope = F.when(F.col("scope") == "production", 0).when(F.col("scope") == "test", 1).otherwise(2)
    return rows.orderBy(scope, F.col("score").desc(), "file_id").limit(100)


_SCORE = f"""{_FINDINGS}, units AS (SELECT f.project_id, fs.scope, count(*) AS files, sum(f.line_count) AS lines, (SELECT count(*) FROM s JOIN fs z USING (file_id) WHERE s.project_id = f.project_id AND z.scope = fs.scope) AS symbols FROM f JOIN fs USING (file_id) GROUP BY f.project_id, fs.scope),
pen AS (SELECT u.project_id, u.scope, rule_id, least(20.0, sum(CASE WHEN severity = 'error' THEN 8.0 ELSE 3.0 END / greatest(1.0, files / 50.0, lines / 10000.0, symbols / 500.0))) AS p FROM units u JOIN fnd USING (project_id, scope) GROUP BY ALL),
sc AS (SELECT u.project_id, u.scope, 100 - CAST(least(100, coalesce(ceil(round((SELECT sum(p) FROM pen WHERE pen.project_id = u.project_id AND pen.scope = u.scope), 9)), 0)) AS BIGINT) AS score FROM units u)"""


@register("agg13_quality_score", with_views("f fs c s m", f"WITH {_SCORE} SELECT project_id, scope, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM sc"))
def agg13(spark: SparkSession, d: str) -> DataFrame:
    scored = Q.scope_scores(findings(spark, d), T.files(spark, d), T.symbols(spark, d))
    return scored.select("project_id", "scope", "score", S.grade(F.col("score")).alias("grade"))


@register("agg15_composite_score", with_views("f fs c s m", f"""
WITH {_SCORE}, w AS (SELECT *, CASE scope WHEN 'production' THEN 0.7 WHEN 'test' THEN 0.2 ELSE 0.1 END AS w FROM sc) SELECT project_id, CAST(round_even(round(sum(score * w) / sum(w), 9), 0) AS BIGINT) AS score FROM w GROUP BY project_id"""))
def agg15(spark: SparkSession, d: str) -> DataFrame:
    return Q.composite(Q.scope_scores(findings(spark, d), T.files(spark, d), T.symbols(spark, d)))


@register("srt10_finding_order", with_views("f fs c s m", f"""
WITH {_FINDINGS} SELECT rule_id, f.path, CAST(start_line AS BIGINT) AS start_line, severity FROM fnd JOIN f USING (file_id) ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, f.path, start_line NULLS FIRST, rule_id, file_id LIMIT 100"""))
def srt10(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).join(T.files(spark, d).select("file_id", "path"), "file_id")
    return rows.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "path", "start_line", "rule_id", "file_id").limit(100).select("rule_id", "path", F.col("start_line").cast("long").alias("start_line"), "severity")


@register("qlt07_circular_dependency", with_views("e", f"""
WITH {_CLOSURE}, k AS (SELECT e.*, a.component FROM e JOIN scc a ON a.graph_id = e.graph_id AND a.node = e.src JOIN scc b ON b.graph_id = e.graph_id AND b.node = e.dst AND a.component = b.component)
SELECT graph_id, component, src AS located_at, CAST(line AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, component ORDER BY line, src, dst) AS rn FROM k) WHERE rn = 1""", recursive=True))
def qlt07(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    return Q.circular_dependencies(edges, G.strongly_connected(edges))


@register("fn14_threshold_percent", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT file_id, greatest(0, CAST(round_even((metric - 100) * 100.0 / 100, 0) AS BIGINT)) AS over_percent FROM fnd WHERE rule_id = 'LARGE_FILE'"))
def fn14(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).where("rule_id = 'LARGE_FILE'")
    return rows.select("file_id", F.greatest(F.lit(0), F.bround((F.col("metric") - 100) * 100.0 / 100).cast("long")).alias("over_percent"))
