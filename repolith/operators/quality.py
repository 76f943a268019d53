"""Rule findings, scores and change risk over files, symbols, imports and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators.graph import two_hops

# Default thresholds and weights of the rules.
FILE_LINES, FUNCTION_LINES, CLASS_LINES, IMPORTS, FAN_OUT = 1_000, 80, 500, 25, 10
SCOPE_WEIGHTS = {"production": 0.7, "test": 0.2, "generated": 0.1}
SEVERITY_WEIGHTS = {"error": 8.0, "warning": 3.0, "info": 1.0}
UNIT_FILES, UNIT_LINES, UNIT_SYMBOLS, RULE_CAP = 50, 10_000, 500, 20.0
API_TERMS = ["api", "routes", "route", "controller", "endpoint"]
DATA_TERMS = ["db", "queries", "models", "model", "database"]


def _finding(rows: DataFrame, rule: str, start: Column, metric: Column, threshold: int, multiplier: int) -> DataFrame:
    hit = rows.withColumn("metric", metric).where(F.col("metric") > threshold)
    return hit.select(
        "project_id", "scope", F.lit(rule).alias("rule_id"), "file_id", start.cast("int").alias("start_line"), S.severity(F.col("metric"), threshold, multiplier).alias("severity"), F.col("metric").cast("long").alias("metric"), F.lit(threshold).alias("threshold")
    )


def large_files(files: DataFrame, *, threshold: int = FILE_LINES) -> DataFrame:
    return _finding(files.withColumn("scope", S.code_scope(F.col("path"))), "LARGE_FILE", F.lit(1), F.col("line_count"), threshold, 3)


def findings(files: DataFrame, symbols: DataFrame, imports: DataFrame, *, file_lines: int = FILE_LINES, function_lines: int = FUNCTION_LINES, class_lines: int = CLASS_LINES, imports_per_file: int = IMPORTS, fan_out: int = FAN_OUT) -> DataFrame:
    """project_id, scope, rule_id, file_id, start_line, severity, metric, threshold of the size and coupling rules.

    Fan-out is only looked at where imports carry ``resolved_file_id``.
    """
    scoped = files.select("file_id", S.code_scope(F.col("path")).alias("scope"))
    sized = symbols.join(scoped, "file_id").withColumn("span", F.col("end_line") - F.col("start_line") + 1)
    long_functions = _finding(sized.where(F.col("kind").isin("function", "method")), "LONG_FUNCTION", F.col("start_line"), F.col("span"), function_lines, 2)
    large_classes = _finding(sized.where(F.col("kind").isin("class", "interface")), "LARGE_CLASS", F.col("start_line"), F.col("span"), class_lines, 2)
    counted = imports.groupBy("project_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first")).join(scoped, "file_id")
    rules = [large_files(files, threshold=file_lines), long_functions, large_classes, _finding(counted, "TOO_MANY_IMPORTS", F.col("first"), F.col("n"), imports_per_file, 2)]
    if "resolved_file_id" in imports.columns:
        inner = imports.where("resolved_file_id is not null").groupBy("project_id", "file_id").agg(F.count_distinct("resolved_file_id").alias("n"), F.min("line_number").alias("first")).join(scoped, "file_id")
        rules.append(_finding(inner, "HIGH_FAN_OUT", F.col("first"), F.col("n"), fan_out, 2))
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def circular_dependencies(edges: DataFrame, components: DataFrame) -> DataFrame:
    """graph_id, component, located_at, line: one finding per cycle, at its intra-cycle edge with the smallest line."""
    side = lambda end, name: components.select("graph_id", F.col("node").alias(end), F.col("component").alias(name))
    inside = edges.join(side("src", "component"), ["graph_id", "src"]).join(side("dst", "other"), ["graph_id", "dst"]).where("component = other")
    first = inside.groupBy("graph_id", "component").agg(F.min(F.struct("line", "src", "dst")).alias("e"))
    return first.select("graph_id", "component", F.col("e.src").alias("located_at"), F.col("e.line").cast("long").alias("line"))


def scope_scores(found: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """project_id, scope, score: 100 minus the capped, size-scaled penalties of all rules."""
    scoped = files.withColumn("scope", S.code_scope(F.col("path")))
    size = scoped.groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))
    named = symbols.join(scoped.select("file_id", "scope"), "file_id").groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("symbols"))
    units = size.join(named, ["project_id", "scope"], "left").na.fill(0, ["symbols"])
    unit = F.greatest(F.lit(1.0), F.col("files") / UNIT_FILES, F.col("lines") / UNIT_LINES, F.col("symbols") / UNIT_SYMBOLS)
    weight = F.when(F.col("severity") == "error", SEVERITY_WEIGHTS["error"]).when(F.col("severity") == "warning", SEVERITY_WEIGHTS["warning"]).otherwise(SEVERITY_WEIGHTS["info"])
    rules = found.groupBy("project_id", "scope", "rule_id").agg(F.sum(weight).alias("w"))
    penalty = rules.join(units.withColumn("unit", unit), ["project_id", "scope"]).groupBy("project_id", "scope").agg(F.sum(F.least(F.lit(RULE_CAP), F.col("w") / F.col("unit"))).alias("p"))
    total = F.least(F.lit(100), F.coalesce(F.ceil(F.round("p", 9)), F.lit(0)))
    return units.join(penalty, ["project_id", "scope"], "left").select("project_id", "scope", (F.lit(100) - total).cast("long").alias("score"))


def composite(scores: DataFrame) -> DataFrame:
    """project_id, score: scopes weighted, weights renormalised over the scopes there are."""
    weight = F.when(F.col("scope") == "production", SCOPE_WEIGHTS["production"]).when(F.col("scope") == "test", SCOPE_WEIGHTS["test"]).otherwise(SCOPE_WEIGHTS["generated"])
    return scores.withColumn("w", weight).groupBy("project_id").agg(F.bround(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 9)).cast("long").alias("score"))


def risk(edges: DataFrame, components: DataFrame) -> DataFrame:
    """graph_id, node, score, level of changing each node (no test evidence is known at this level)."""
    once = edges.select("graph_id", "src", "dst").distinct()
    nodes = once.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    apart = once.where("src <> dst")
    callers = apart.groupBy("graph_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("callers"))
    uses = apart.groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deps"))
    far = two_hops(edges).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("indirect"))
    files = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("files"))
    cyclic = components.select("graph_id", "node").distinct().withColumn("cyclic", F.lit(15))
    t = nodes.join(callers, ["graph_id", "node"], "left").join(uses, ["graph_id", "node"], "left").join(far, ["graph_id", "node"], "left").join(cyclic, ["graph_id", "node"], "left").join(files, "graph_id").na.fill(0)
    blast = F.round((F.col("callers") + F.col("indirect")) * 100.0 / F.greatest(F.lit(1), F.col("files")), 2)
    score = (
        F.lit(8) + S.reference_points(F.col("callers"), 8, 20) + S.reference_points(F.col("deps"), 6, 10) + S.reference_points(F.col("indirect"), 8, 10) + S.reference_points(blast, 5, 12)
        + F.col("cyclic") + F.when(S.path_has_term(F.col("node"), API_TERMS), 8).otherwise(0) + F.when(S.path_has_term(F.col("node"), DATA_TERMS), 10).otherwise(0) + 8
    )
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return t.select("graph_id", "node", bounded.alias("score"), F.when(score >= 65, "high").when(score >= 35, "medium").otherwise("low").alias("level"))
