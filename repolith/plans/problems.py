"""Queries of the general data-pipeline problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolith.operators import snapshot_changes
from repolith.plans.registry import register
from repolith.runtime import read_table

_CHANGES = """
WITH readable AS (
  SELECT project_id, snapshot_id, min(created_at) AS created_at, min_by(data_json, created_at) AS data_json
  FROM snapshots WHERE json_valid(data_json) AND project_id IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY ALL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at NULLS FIRST, snapshot_id) AS seq FROM readable),
lists AS (
  SELECT project_id, seq, 'finding' AS section, unnest(json_extract(data_json, '$.quality.findings[*]')) AS item, generate_subscripts(json_extract(data_json, '$.quality.findings[*]'), 1) AS place FROM numbered
  UNION ALL SELECT project_id, seq, 'parse_issue', unnest(json_extract(data_json, '$.parse_issues[*]')), generate_subscripts(json_extract(data_json, '$.parse_issues[*]'), 1) FROM numbered
  UNION ALL SELECT project_id, seq, 'cycle', unnest(json_extract(data_json, '$.dependency.cycles[*]')), generate_subscripts(json_extract(data_json, '$.dependency.cycles[*]'), 1) FROM numbered),
fields AS (
  SELECT project_id, seq, section, place, item ->> '$.key' AS item_key,
    list_sort(list_transform(list_filter(json_keys(item), lambda k: json_type(item, '$."' || k || '"') <> 'NULL'),
      lambda k: k || '=' || CASE WHEN json_type(item, '$."' || k || '"') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(item ->> ('$."' || k || '"') AS DOUBLE) AS VARCHAR)
        WHEN json_type(item, '$."' || k || '"') = 'VARCHAR' THEN 's' || (item ->> ('$."' || k || '"'))
        WHEN json_type(item, '$."' || k || '"') = 'ARRAY' THEN CAST(CAST(item -> ('$."' || k || '"') AS VARCHAR[]) AS VARCHAR) ELSE CAST(item -> ('$."' || k || '"') AS VARCHAR) END)) AS body
  FROM lists WHERE json_type(item, '$.key') = 'VARCHAR'),
states AS (SELECT project_id, seq, section, item_key, max_by(body, place) AS body FROM fields GROUP BY ALL),
pairs AS (
  SELECT coalesce(b.project_id, a.project_id) AS project_id, coalesce(b.seq, a.seq + 1) AS seq,
    coalesce(b.section, a.section) AS section, coalesce(b.item_key, a.item_key) AS item_key,
    CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' WHEN a.body <> b.body THEN 'changed' END AS change_kind
  FROM states a FULL JOIN states b ON a.project_id = b.project_id AND a.section = b.section AND a.item_key = b.item_key AND b.seq = a.seq + 1)
"""

P1_SQL = _CHANGES + """
SELECT p.project_id, n.snapshot_id, p.section, p.item_key, p.change_kind
FROM pairs p JOIN numbered n ON n.project_id = p.project_id AND n.seq = p.seq
WHERE p.seq > 1 AND p.change_kind IS NOT NULL"""

P1_TOTALS_SQL = _CHANGES + """
SELECT p.project_id, p.section, p.change_kind, count(*) AS changes
FROM pairs p JOIN numbered n ON n.project_id = p.project_id AND n.seq = p.seq
WHERE p.seq > 1 AND p.change_kind IS NOT NULL GROUP BY ALL"""


@register("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(read_table(spark, sf_dir, "snapshots"))


@register("p1_totals", P1_TOTALS_SQL)
def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes.change_totals(read_table(spark, sf_dir, "snapshots"))
