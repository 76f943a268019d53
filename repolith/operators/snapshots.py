"""Analysis snapshots: payloads, fingerprints, comparability, metric deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"score": "$.quality.score", "total_findings": "$.quality.total_findings", "file_count": "$.project.file_count", "symbol_count": "$.structure.symbol_count", "import_count": "$.structure.import_count"}
CONTEXT = {"scoring_model": "$.analysis_context.scoring_model", "rules_signature": "$.analysis_context.rules_signature", "parser_signature": "$.analysis_context.parser_signature"}


def snapshot_metrics(payloads: DataFrame) -> DataFrame:
    """project_id, snapshot_id, created_at, the metrics as bigint and the context fields as text."""
    number = lambda path: F.get_json_object("data_json", path).cast("double").cast("long")
    return payloads.select(
        "project_id", "snapshot_id", "created_at", "reason", *[number(p).alias(n) for n, p in METRICS.items()], *[F.get_json_object("data_json", p).alias(n) for n, p in CONTEXT.items()]
    )


def compared(metrics: DataFrame) -> DataFrame:
    """Each snapshot with its predecessor: deltas (null where the two are not comparable), warnings.

    The number of files is a count and compared in any case.
    """
    line = Window.partitionBy("project_id").orderBy(F.col("created_at").asc_nulls_first(), "snapshot_id")
    before = {n: F.lag(n).over(line) for n in [*METRICS, *CONTEXT, "snapshot_id"]}
    rows = metrics.select("*", *[c.alias(f"base_{n}") for n, c in before.items()]).where("base_snapshot_id is not null")
    warnings = F.array_compact(
        F.array(
            *[F.when(~F.col(n).eqNullSafe(F.col(f"base_{n}")), F.lit(f"{n} differs")) for n in CONTEXT],
            *[F.when(F.col(n).isNull() | F.col(f"base_{n}").isNull(), F.lit(f"{n} missing")) for n in ("scoring_model", "parser_signature")],
            F.when(F.col("score").isNull() | F.col("base_score").isNull(), F.lit("score missing")),
        )
    )
    rows = rows.withColumn("warnings", warnings)
    good = F.size("warnings") == 0
    deltas = [(F.col(n) - F.col(f"base_{n}") if n == "file_count" else F.when(good, F.col(n) - F.col(f"base_{n}"))).alias(f"{n}_delta") for n in METRICS]
    return rows.select("project_id", "snapshot_id", "base_snapshot_id", *deltas, "warnings")


def rule_signature(findings: DataFrame) -> DataFrame:
    """project_id, signature: sha-256 of the sorted rule names, independent of row order."""
    rules = findings.groupBy("project_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
    return rules.select("project_id", F.sha2(F.to_json(F.struct(F.col("rules"))), 256).alias("signature"))


def payload(scores: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, data_json: one nested row per project, as a snapshot keeps it."""
    size = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("line_count").alias("code_line_count"))
    item = F.struct(F.concat_ws("|", "rule_id", "file_id", F.coalesce(F.col("start_line").cast("string"), F.lit("0"))).alias("key"), "rule_id", "severity", "scope", "file_id", "start_line", "metric", "threshold")
    listed = findings.groupBy("project_id").agg(F.sort_array(F.collect_list(item)).alias("findings"))
    best = scores.groupBy("project_id").agg(F.min("score").alias("score"))
    rows = size.join(listed, "project_id", "left").join(best, "project_id", "left")
    body = F.to_json(F.struct(F.struct("file_count", "code_line_count").alias("project"), F.struct("score", F.coalesce("findings", F.array()).alias("findings")).alias("quality")))
    return rows.select("project_id", body.alias("data_json"))
