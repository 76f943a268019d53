"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolith.llm import abuse, credentials, packing, provenance, splitting, syntax_check, tokenizer
from repolith.runtime import read_table

#: Which chunks are above a limit; how they are cut is tested by exact round trips.
P5_SQL = """
SELECT DISTINCT chunk_id FROM chunks
WHERE length(content) > 16000
   OR length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR right(content, 1) = chr(10) THEN 0 ELSE 1 END > 80"""

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "files"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted_chunks(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "files"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_check.check_files(read_table(spark, sf_dir, "files"), read_table(spark, sf_dir, "sources"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_check.broken_files(p3_files(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_check.error_rates(p3_files(spark, sf_dir))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.judged_files(read_table(spark, sf_dir, "files"), read_table(spark, sf_dir, "sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.flagged_files(p4_files(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(read_table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_chunks(p5_pieces(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.token_ids(read_table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(tokenizer.token_counts(read_table(spark, sf_dir, "documents")))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p7_containers(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.flagged(p8_scores(spark, sf_dir))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates, "p4_found": p4_found, "p4_files": p4_files, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}
