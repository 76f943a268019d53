"""The canonical tables as SQL for the oracles (see ``repolith.sources.tables``)."""

_FILES = r"""f AS (SELECT project_id, file_id, path, regexp_extract(path, '(\.[^./]*)$', 1) AS suffix, line_count, size_bytes, content_hash, modified_time_ns FROM (
  SELECT project_id, file_id, replace(relative_path, '\', '/') AS path, coalesce(line_count, 0) AS line_count, size_bytes, content_hash, modified_time_ns,
    row_number() OVER (PARTITION BY file_id ORDER BY modified_time_ns DESC NULLS LAST, content_hash NULLS FIRST, coalesce(line_count, 0)) AS rn FROM files) WHERE rn = 1)"""
_SCOPED = """fs AS (SELECT *, CASE WHEN list_has_any(parts, ['test', 'tests', 'spec', 'specs', '__tests__']) OR name IN ('test.py', 'tests.py', 'spec.py', 'spec.ts', 'spec.js')
    OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR contains(name, '.test.') OR contains(name, '.spec.') THEN 'test'
  WHEN list_has_any(parts, ['build', 'coverage', 'dist', 'generated', 'node_modules', 'vendor']) OR contains(name, '.min.') THEN 'generated' ELSE 'production' END AS scope
  FROM (SELECT *, string_split(lower(path), '/') AS parts, string_split(lower(path), '/')[-1] AS name FROM f))"""
_SOURCES = "src AS (SELECT file_id, max(content) AS content FROM sources WHERE content IS NOT NULL GROUP BY file_id)"
_CHUNKS = """c AS (SELECT project_id, chunk_id, file_id, symbol_name, kind, start_line, end_line, content FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY file_id NULLS LAST, symbol_name NULLS LAST, kind NULLS LAST, start_line NULLS LAST, end_line NULLS LAST, content NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"""
_SYMBOLS = """s AS (SELECT project_id, chunk_id AS symbol_id, file_id, string_split(symbol_name, '.')[-1] AS name, symbol_name AS qualified_name, kind, start_line, end_line
  FROM c WHERE symbol_name IS NOT NULL AND kind IN ('class', 'interface', 'function', 'method'))"""
_PARSES = """p AS (SELECT project_id, file_id, has_syntax_errors, symbol_count, import_count, parsed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC NULLS LAST, has_syntax_errors DESC NULLS LAST, symbol_count NULLS FIRST) AS rn FROM parse_results) WHERE rn = 1)"""
_ISSUES = "i AS (SELECT project_id, file_id AS issue_id, file_id, 'Syntax error' AS message FROM p WHERE has_syntax_errors)"
_IMPORTS = r"""m AS (SELECT * FROM (SELECT f.project_id, f.file_id, f.path AS source_path, f.suffix,
    CASE WHEN suffix = '.py' THEN regexp_extract(l, '^from ([\w.]+) import', 1) || regexp_extract(l, '^import ([\w.]+)', 1)
      ELSE regexp_extract(l, '^import .* from ["'']([^"'']+)["'']', 1) END AS target_module, n AS line_number
  FROM f JOIN src USING (file_id), unnest(string_split(replace(content, chr(13), ''), chr(10))) WITH ORDINALITY AS t(l, n)
  WHERE suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx') AND (starts_with(l, 'import ') OR starts_with(l, 'from '))) WHERE target_module <> '')"""
_PATH_IMPORTS = r"""pm AS (WITH code AS (SELECT project_id, file_id, path AS source_path, suffix, suffix = '.py' AS py, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx')),
  ends AS (SELECT project_id, py, dir, min(source_path) AS first, max(source_path) AS last FROM code GROUP BY ALL),
  own AS (SELECT code.*, CASE WHEN source_path = first THEN last ELSE first END AS target, CASE WHEN source_path = first THEN 2 ELSE 1 END AS line_number FROM code JOIN ends USING (project_id, py, dir)),
  up AS (SELECT code.*, o.first AS target, 3 AS line_number FROM code JOIN ends e USING (project_id, py, dir) JOIN ends o ON o.project_id = code.project_id AND o.py = code.py AND o.dir = regexp_extract(code.dir, '^(.*)/[^/]*$', 1) WHERE source_path = e.first AND code.dir <> ''),
  hub AS (SELECT code.*, (SELECT min(o.source_path) FROM code o WHERE o.project_id = code.project_id AND o.py = code.py) AS target, 4 AS line_number FROM code),
  every AS (SELECT *, regexp_replace(target, '\.[^./]*$', '') AS stem, CASE line_number WHEN 3 THEN '..' ELSE '.' END AS dots, file_id % 2 = 0 OR line_number = 4 AS whole FROM (SELECT * FROM own WHERE source_path <> target UNION ALL SELECT * FROM up UNION ALL SELECT * FROM hub WHERE source_path <> target))
  SELECT project_id, file_id, source_path, suffix, line_number, CASE WHEN py THEN CASE WHEN whole THEN replace(stem, '/', '.') ELSE dots || string_split(stem, '/')[-1] END
    ELSE CASE WHEN whole THEN '/' || stem ELSE dots || '/' || string_split(stem, '/')[-1] END END AS target_module FROM every)"""
_PATH_RESOLVED = r"""pr AS (WITH a AS (SELECT project_id, file_id, regexp_replace(replace(regexp_replace(path, '\.[^./]*$', ''), '/', '.'), '(^|\.)__init__$', '') AS alias FROM f WHERE suffix = '.py'),
  b AS (SELECT project_id, file_id, alias FROM a WHERE alias <> '' UNION SELECT project_id, file_id, regexp_replace(alias, '^[^.]+\.', '') FROM a WHERE regexp_matches(alias, '^(src|backend|server|python)\.')),
  x AS (SELECT project_id, alias, min(file_id) AS target_id FROM b GROUP BY ALL HAVING count(DISTINCT file_id) = 1),
  n AS (SELECT *, len(regexp_extract(target_module, '^(\.*)', 1)) AS level, string_split(source_path, '/')[:-2] AS folder FROM pm),
  py AS (SELECT n.*, array_to_string(list_concat(CASE WHEN level > 0 THEN folder[: len(folder) - level + 1] ELSE [] END, [regexp_replace(target_module, '^\.+', '')]), '.') AS name FROM n WHERE suffix = '.py'),
  js AS (SELECT n.*, CASE WHEN starts_with(target_module, '/') THEN substr(target_module, 2) ELSE array_to_string(list_concat(CASE WHEN starts_with(target_module, '../') THEN folder[:-2] ELSE folder END, [string_split(target_module, '/')[-1]]), '/') END AS base FROM n WHERE suffix <> '.py'),
  t AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.d.ts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.d.ts']) AS tail, unnest(range(0, 11)) AS priority)
  SELECT py.project_id, py.file_id, py.source_path, target_module, line_number, x.target_id AS resolved_file_id FROM py LEFT JOIN x ON x.project_id = py.project_id AND x.alias = py.name
  UNION ALL SELECT js.project_id, js.file_id, js.source_path, target_module, line_number, min_by(f.file_id, priority) FROM js CROSS JOIN t LEFT JOIN f ON f.project_id = js.project_id AND f.path = js.base || t.tail GROUP BY ALL)"""
_PATH_EDGES = "pe AS (SELECT pr.project_id AS graph_id, pr.source_path AS src, f.path AS dst, CAST(line_number AS BIGINT) AS line FROM pr JOIN f ON f.file_id = pr.resolved_file_id)"
_PAYLOADS = """pay AS (SELECT project_id, snapshot_id, created_at, label, reason, data_json FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY created_at NULLS FIRST, data_json) AS rn FROM snapshots WHERE json_valid(data_json)) WHERE rn = 1)"""
_EDGES = """e AS (SELECT graph_id, paths[k] AS src, paths[k % len(paths) + 1] AS dst, k AS line FROM (
  SELECT graph_id, paths, unnest(range(1, len(paths) + 1)) AS k FROM (
    SELECT snapshot_id AS graph_id, CAST(unnest(json_extract(data_json, '$.dependency.cycles[*].paths')) AS VARCHAR[]) AS paths FROM pay)))"""

_ALL = {"f": _FILES, "fs": _SCOPED, "src": _SOURCES, "c": _CHUNKS, "s": _SYMBOLS, "p": _PARSES, "i": _ISSUES, "m": _IMPORTS, "pm": _PATH_IMPORTS, "pr": _PATH_RESOLVED, "pe": _PATH_EDGES, "pay": _PAYLOADS, "e": _EDGES}
_NEEDS = {"fs": ["f"], "s": ["c"], "i": ["p"], "m": ["f", "src"], "pm": ["f"], "pr": ["f", "pm"], "pe": ["pr"], "e": ["pay"]}


def with_views(names: str, query: str, *, recursive: bool = False) -> str:
    """``query`` behind the WITH clause of the views it names (blank-separated)."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = query.strip()
    joined = ",\n".join(_ALL[n] for n in order)
    if body.upper().startswith("WITH "):
        return head + joined + ",\n" + body[5:]
    return head + joined + "\n" + body
