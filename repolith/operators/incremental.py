"""Incremental analysis: what changed between two scans, and rewriting only that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_changes(known: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """key, state: added, deleted, changed or unchanged by ``content_hash``; one full outer join.

    A key that occurs twice on a side counts once (smallest hash); null keys are
    compared like values.
    """
    def fold(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"{side}_{k}") for k in key]).agg(F.min("content_hash").alias(side), F.lit(True).alias(f"in_{side}"))

    old, new = fold(known, "old"), fold(scanned, "new")
    match = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in key]
    both = old.join(new, match, "full")
    state = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    )
    return both.select(*[F.coalesce(f"old_{k}", f"new_{k}").alias(k) for k in key], state.alias("state"))


def rewrite(table: DataFrame, fresh: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` without rows of deleted and changed keys, plus ``fresh`` rows of added and changed keys."""
    gone = changes.where(F.col("state").isin("deleted", "changed")).select(*key)
    come = changes.where(F.col("state").isin("added", "changed")).select(*key)
    return table.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def detach(imports: DataFrame, changes: DataFrame) -> DataFrame:
    """imports whose target file was deleted point nowhere."""
    gone = changes.where("state = 'deleted'").select(F.col("file_id").alias("resolved_file_id"), F.lit(True).alias("gone"))
    joined = imports.join(gone, "resolved_file_id", "left")
    return joined.withColumn("resolved_file_id", F.when(F.col("gone").isNull(), F.col("resolved_file_id"))).drop("gone").select(*imports.columns)
