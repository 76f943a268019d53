"""Queries over files, symbols and imports: scans, predicates, joins, aggregates, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions import scalars as S
from repolith.operators import structure as O
from repolith.plans.registry import register
from repolith.plans.views import with_views
from repolith.runtime import read_table
from repolith.sources import tables as T

_long = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


@register("src02_line_count", with_views("src", """
SELECT file_id, CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR right(content, 1) = chr(10) THEN 0 ELSE 1 END AS BIGINT) AS lines,
  CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS content_sha FROM src"""))
def src02(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return T.sources(spark, d).select("file_id", S.text_lines(c).cast("long").alias("lines"), F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("content_sha"))


@register("src03_metadata_reuse", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY modified_time_ns DESC NULLS LAST, content_hash NULLS FIRST, coalesce(line_count, 0)) AS rn,
  row_number() OVER (PARTITION BY file_id ORDER BY modified_time_ns NULLS LAST, content_hash NULLS FIRST, coalesce(line_count, 0)) AS ro FROM files)
SELECT n.file_id, coalesce(n.size_bytes = o.size_bytes AND n.modified_time_ns = o.modified_time_ns AND o.modified_time_ns > 0, false) AS reused,
  CASE WHEN n.size_bytes = o.size_bytes AND n.modified_time_ns = o.modified_time_ns AND o.modified_time_ns > 0 THEN o.content_hash ELSE n.content_hash END AS content_hash
FROM r n JOIN r o ON n.file_id = o.file_id AND o.ro = 1 WHERE n.rn = 1""")
def src03(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "files").withColumn("line_count", F.coalesce("line_count", F.lit(0)))
    now = T.newest(raw, ["file_id"], F.col("modified_time_ns").desc_nulls_last(), "content_hash", "line_count")
    known = T.newest(raw, ["file_id"], F.col("modified_time_ns").asc_nulls_last(), "content_hash", "line_count")
    known = known.select("file_id", F.col("size_bytes").alias("s"), F.col("modified_time_ns").alias("t"), F.col("content_hash").alias("h"))
    same = F.coalesce((F.col("size_bytes") == F.col("s")) & (F.col("modified_time_ns") == F.col("t")) & (F.col("t") > 0), F.lit(False))
    return now.join(known, "file_id").select("file_id", same.alias("reused"), F.when(same, F.col("h")).otherwise(F.col("content_hash")).alias("content_hash"))


@register("src04_language_of_suffix", with_views("f", """
SELECT suffix, CASE suffix WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.go' THEN 'Go'
  WHEN '.java' THEN 'Java' WHEN '.sql' THEN 'SQL' WHEN '.css' THEN 'CSS' END AS language, suffix IN ('.env', '.json', '.md', '.toml', '.txt', '.yaml', '.yml') AS plain_text, count(*) AS files
FROM f GROUP BY ALL"""))
def src04(spark: SparkSession, d: str) -> DataFrame:
    rows = T.files(spark, d).groupBy("suffix").agg(F.count(F.lit(1)).alias("files"))
    return rows.select("suffix", S.language_of(F.col("suffix")).alias("language"), F.col("suffix").isin(S.TEXT_SUFFIXES).alias("plain_text"), "files")


@register("src09_commit_metadata", """
SELECT project_id, lower(source_commit) AS head_commit, substr(source_commit, 1, 7) AS short_commit FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST, source_commit NULLS LAST, name) AS rn FROM projects)
WHERE rn = 1 AND regexp_full_match(source_commit, '[0-9a-fA-F]{40}')""")
def src09(spark: SparkSession, d: str) -> DataFrame:
    rows = T.newest(read_table(spark, d, "projects"), ["project_id"], F.col("updated_at").desc_nulls_last(), F.col("source_commit").asc_nulls_last(), "name")
    good = rows.where(F.col("source_commit").rlike("^[0-9a-fA-F]{40}$"))
    return good.select("project_id", F.lower("source_commit").alias("head_commit"), F.substring("source_commit", 1, 7).alias("short_commit"))


_CHANGED = """o AS (SELECT file_id, max(coalesce(line_count, 0)) - min(coalesce(line_count, 0)) AS additions, max(size_bytes) - min(size_bytes) AS deletions FROM files GROUP BY file_id)"""


@register("src10_commit_comparison", with_views("f", f"""
WITH {_CHANGED}, t AS (SELECT f.file_id, f.path, CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions, CAST(additions + deletions AS BIGINT) AS changes FROM o JOIN f USING (file_id) WHERE additions + deletions > 0)
SELECT *, (SELECT CAST(sum(changes) AS BIGINT) FROM t) AS total_changes, (SELECT count(*) FROM t) > 100 AS truncated FROM t ORDER BY changes DESC, path, file_id LIMIT 100"""))
def src10(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "files").withColumn("line_count", F.coalesce("line_count", F.lit(0)))
    states = raw.groupBy("file_id").agg((F.max("line_count") - F.min("line_count")).cast("long").alias("additions"), (F.max("size_bytes") - F.min("size_bytes")).cast("long").alias("deletions"))
    changed = T.files(spark, d).select("file_id", "path").join(states, "file_id").withColumn("changes", F.col("additions") + F.col("deletions")).where("changes > 0")
    total = changed.agg(F.sum("changes").alias("total_changes"), (F.count(F.lit(1)) > 100).alias("truncated"))  # one row
    return changed.orderBy(F.col("changes").desc(), "path", "file_id").limit(100).crossJoin(F.broadcast(total))


@register("src11_file_content", with_views("f src", r"""
SELECT f.project_id, f.file_id, f.path, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_parts, string_split(content, chr(10))[1] AS first_line
FROM f JOIN src USING (file_id) WHERE strlen(content) <= 2097152 AND NOT contains(content, chr(0)) AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.(/|$)')"""))
def src11(spark: SparkSession, d: str) -> DataFrame:
    rows = T.files(spark, d).join(T.sources(spark, d), "file_id")
    safe = rows.where((F.octet_length("content") <= 2 << 20) & ~F.col("content").contains("\0") & ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    lines = F.split("content", "\n")
    return safe.select("project_id", "file_id", "path", F.size(lines).cast("long").alias("n_parts"), F.element_at(lines, 1).alias("first_line"))


@register("src14_keep_last_snapshots", with_views("pay", """
SELECT project_id, snapshot_id, CAST(rn AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, snapshot_id DESC) AS rn FROM pay) WHERE rn <= 30"""))
def src14(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("project_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("snapshot_id").desc())
    return T.payloads(spark, d).withColumn("position", F.row_number().over(line).cast("long")).where("position <= 30").select("project_id", "snapshot_id", "position")


@register("src18_project_upsert", """
SELECT project_id, trim(name) AS name, status, primary_language, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST, name, status) AS rn FROM projects) WHERE rn = 1""")
def src18(spark: SparkSession, d: str) -> DataFrame:
    rows = T.newest(read_table(spark, d, "projects"), ["project_id"], F.col("updated_at").desc_nulls_last(), "name", "status")
    return rows.select("project_id", F.trim("name").alias("name"), "status", "primary_language", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("prs03_imports", with_views("m", "SELECT project_id, file_id, target_module, CAST(line_number AS BIGINT) AS line_number FROM m"))
def prs03(spark: SparkSession, d: str) -> DataFrame:
    return T.imports(spark, d).select("project_id", "file_id", "target_module", _long("line_number").alias("line_number"))


_INDEX = r"""a AS (SELECT project_id, file_id, regexp_replace(replace(regexp_replace(path, '\.[^./]*$', ''), '/', '.'), '(^|\.)__init__$', '') AS alias FROM f WHERE suffix = '.py'),
b AS (SELECT project_id, file_id, alias FROM a WHERE alias <> '' UNION SELECT project_id, file_id, regexp_replace(alias, '^[^.]+\.', '') FROM a WHERE regexp_matches(alias, '^(src|backend|server|python)\.')),
x AS (SELECT project_id, alias, min(file_id) AS file_id FROM b GROUP BY ALL HAVING count(DISTINCT file_id) = 1)"""


@register("prs05_module_index", with_views("f", f"WITH {_INDEX} SELECT * FROM x WHERE alias <> ''"))
def prs05(spark: SparkSession, d: str) -> DataFrame:
    return O.python_module_index(T.files(spark, d))


_RESOLVED = _INDEX + r""", r AS (SELECT m.*, coalesce(x.file_id, j.file_id) AS resolved_file_id FROM m
  LEFT JOIN x ON m.suffix = '.py' AND x.project_id = m.project_id AND x.alias = m.target_module
  LEFT JOIN f j ON m.suffix <> '.py' AND j.project_id = m.project_id AND j.path = ltrim(m.target_module, '/'))"""


@register("prs06_resolve_imports", with_views("f m", f"""WITH {_RESOLVED}
SELECT project_id, file_id, target_module, CAST(line_number AS BIGINT) AS line_number, resolved_file_id FROM r"""))
def prs06(spark: SparkSession, d: str) -> DataFrame:
    return O.resolve_imports(T.imports(spark, d), T.files(spark, d)).select("project_id", "file_id", "target_module", _long("line_number").alias("line_number"), "resolved_file_id")


@register("prs07_javascript_candidates", with_views("f", r"""
WITH b AS (SELECT project_id, file_id, regexp_replace(path, '(/index)?\.[^./]*$', '') AS base FROM f WHERE suffix IN ('.js', '.jsx', '.ts', '.tsx')),
k AS (SELECT b.*, unnest(['', '.ts', '.tsx', '.js', '.jsx', '.d.ts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.d.ts']) AS tail, unnest(range(0, 11)) AS priority FROM b)
SELECT k.project_id, k.file_id, k.base, arg_min(f.file_id, k.priority * 1000000000000 + f.file_id) AS resolved_file_id
FROM k JOIN f ON f.project_id = k.project_id AND f.path = k.base || k.tail GROUP BY ALL"""))
def prs07(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d)
    base = files.where(F.col("suffix").isin(".js", ".jsx", ".ts", ".tsx")).select("project_id", "file_id", F.regexp_replace("path", r"(/index)?\.[^./]*$", "").alias("base"))
    tried = base.select("project_id", "file_id", "base", F.posexplode(O.javascript_candidates(F.col("base"))).alias("priority", "candidate"))
    return O.first_match(tried, ["project_id", "file_id", "base"], files)


@register("prs09_config_scope", with_views("f", r"""
WITH d AS (SELECT DISTINCT project_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM f WHERE suffix IN ('.json', '.toml', '.yaml', '.yml'))
SELECT f.project_id, f.file_id, max_by(d.directory, length(d.directory)) AS directory, count(*) AS applicable
FROM f JOIN d ON f.project_id = d.project_id AND (d.directory = '' OR starts_with(f.path, d.directory || '/')) GROUP BY ALL"""))
def prs09(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d)
    folder = P.parent(F.col("path"))
    configs = files.where(F.col("suffix").isin(".json", ".toml", ".yaml", ".yml")).select("project_id", folder.alias("directory")).distinct()
    # Every file meets its own ancestor folders: an equi join instead of a prefix join.
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    rows = files.select("project_id", "file_id", F.explode(ancestors).alias("directory")).join(configs, ["project_id", "directory"])
    return rows.groupBy("project_id", "file_id").agg(F.max_by("directory", F.length("directory")).alias("directory"), F.count(F.lit(1)).alias("applicable"))


@register("prs11_subset_reanalysis", with_views("c s p", """
SELECT s.project_id, s.symbol_id, false AS fresh FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.file_id = s.file_id AND p.has_syntax_errors)
UNION ALL SELECT s.project_id, s.symbol_id, true FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.file_id = s.file_id AND p.has_syntax_errors)"""))
def prs11(spark: SparkSession, d: str) -> DataFrame:
    symbols, changed = T.symbols(spark, d), T.parses(spark, d).where("has_syntax_errors").select("file_id")
    old = symbols.join(changed, "file_id", "left_anti").withColumn("fresh", F.lit(False))
    new = symbols.join(changed, "file_id", "left_semi").withColumn("fresh", F.lit(True))
    return old.unionByName(new).select("project_id", "symbol_id", "fresh")


@register("flt01_code_scope", with_views("fs", "SELECT file_id, scope FROM fs"))
def flt01(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("file_id", S.code_scope(F.col("path")).alias("scope"))


_ROOTS = r"roots AS (SELECT DISTINCT project_id, unnest([a, regexp_replace(a, '\.[^.]*$', '')]) AS root FROM (SELECT project_id, lower(string_split(path, '/')[1]) AS a FROM f))"


@register("flt02_unresolved_class", with_views("f m", rf"""
WITH {_INDEX}, {_ROOTS}, t AS (SELECT m.*, lower(trim(target_module)) AS low,
  CASE WHEN suffix = '.py' THEN string_split(regexp_replace(lower(trim(target_module)), '^\.+', ''), '.')[1]
    WHEN starts_with(lower(trim(target_module)), '@') AND contains(target_module, '/') THEN string_split(lower(trim(target_module)), '/')[1] || '/' || string_split(lower(trim(target_module)), '/')[2]
    ELSE string_split(ltrim(lower(trim(target_module)), '/'), '/')[1] END AS root FROM m)
SELECT t.project_id, target_module, CASE WHEN regexp_matches(low, '^[./]') OR low = '' THEN 'unresolved' WHEN suffix <> '.py' AND starts_with(low, 'node:') THEN 'likely_external'
  WHEN suffix <> '.py' AND regexp_matches(low, '^[@~]/') THEN 'unresolved' WHEN roots.root IS NOT NULL OR t.root = '' THEN 'unresolved' ELSE 'likely_external' END AS target_class, count(*) AS imports
FROM t LEFT JOIN roots ON roots.project_id = t.project_id AND roots.root = t.root GROUP BY ALL"""))
def flt02(spark: SparkSession, d: str) -> DataFrame:
    marked = O.classify_unresolved(T.imports(spark, d), O.module_roots(T.files(spark, d)))
    return marked.groupBy("project_id", "target_module", "target_class").agg(F.count(F.lit(1)).alias("imports"))


@register("flt03_module_roots", with_views("f", f"WITH {_ROOTS} SELECT * FROM roots WHERE root <> ''"))
def flt03(spark: SparkSession, d: str) -> DataFrame:
    return O.module_roots(T.files(spark, d))


@register("flt04_confidence_level", """
SELECT project_id, round(pct, 1) AS percent, CASE WHEN pct >= 90 THEN 'high' WHEN pct >= 70 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT project_id, 100.0 * count_if(has_syntax_errors IS NOT NULL) / count(*) AS pct FROM parse_results GROUP BY 1)""")
def flt04(spark: SparkSession, d: str) -> DataFrame:
    rates = read_table(spark, d, "parse_results").groupBy("project_id").agg((F.count_if(F.col("has_syntax_errors").isNotNull()) * 100.0 / F.count(F.lit(1))).alias("pct"))
    return rates.select("project_id", F.round("pct", 1).alias("percent"), S.confidence_level(F.col("pct")).alias("level"))


@register("flt05_symbol_filter", with_views("c s f", r"""
SELECT s.symbol_id FROM s JOIN f USING (file_id) WHERE s.name ILIKE '%load_%' OR s.qualified_name ILIKE '%load_%' OR f.path ILIKE '%load_%'"""))
def flt05(spark: SparkSession, d: str) -> DataFrame:
    joined = T.symbols(spark, d).join(T.files(spark, d).select("file_id", "path"), "file_id")
    hit = F.col("name").ilike("%load_%") | F.col("qualified_name").ilike("%load_%") | F.col("path").ilike("%load_%")  # wildcards are not escaped here
    return joined.where(hit).select("symbol_id")


@register("flt06_import_scope", with_views("f m", f"WITH {_RESOLVED} SELECT project_id, CASE WHEN resolved_file_id IS NOT NULL THEN 'internal' ELSE 'external' END AS scope, count(*) AS imports FROM r GROUP BY ALL"))
def flt06(spark: SparkSession, d: str) -> DataFrame:
    resolved = O.resolve_imports(T.imports(spark, d), T.files(spark, d))
    return resolved.groupBy("project_id", F.when(F.col("resolved_file_id").isNotNull(), "internal").otherwise("external").alias("scope")).agg(F.count(F.lit(1)).alias("imports"))


@register("flt07_literal_filter", with_views("f", "SELECT file_id FROM f WHERE contains(lower(path), '_service') OR starts_with(lower(path), 'src/lib/')"))
def flt07(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("path")
    return T.files(spark, d).where(low.contains("_service") | low.startswith("src/lib/")).select("file_id")


@register("flt08_case_prefix", with_views("f", "SELECT file_id FROM f WHERE substr(path, 1, 9) = 'src/main/'"))
def flt08(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).where(F.col("path").startswith("src/main/")).select("file_id")


@register("flt10_path_terms", with_views("f", r"SELECT file_id FROM f WHERE list_has_any(regexp_split_to_array(lower(path), '[/\\._-]+'), ['routes', 'api', 'controller'])"))
def flt10(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).where(S.path_has_term(F.col("path"), ["routes", "api", "controller"])).select("file_id")


@register("flt11_parser_support", with_views("f", "SELECT suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx') AS supported, count(*) AS files FROM f GROUP BY ALL"))
def flt11(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).groupBy(O.supported(F.col("suffix")).alias("supported")).agg(F.count(F.lit(1)).alias("files"))


@register("flt12_test_path", with_views("f", r"""
SELECT file_id, contains('/' || lower(path) || '/', '/test/') OR contains('/' || lower(path) || '/', '/tests/') OR contains(lower(path), '__tests__') OR starts_with(string_split(lower(path), '/')[-1], 'test_')
  OR contains(string_split(lower(path), '/')[-1], '.test.') OR contains(string_split(lower(path), '/')[-1], '.spec.') AS is_test FROM f"""))
def flt12(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("file_id", S.test_path(F.col("path")).alias("is_test"))


@register("jon01_symbols_files", with_views("c s f", "SELECT s.symbol_id, s.kind, f.path, f.suffix FROM s JOIN f USING (file_id)"))
def jon01(spark: SparkSession, d: str) -> DataFrame:
    return T.symbols(spark, d).join(T.files(spark, d), "file_id").select("symbol_id", "kind", "path", "suffix")


@register("jon02_chunks_files", with_views("c f", "SELECT f.suffix, c.kind, count(*) AS chunks, CAST(sum(length(c.content)) AS BIGINT) AS chars FROM c JOIN f USING (file_id) GROUP BY ALL"))
def jon02(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).join(T.files(spark, d).select("file_id", "suffix"), "file_id")
    return rows.groupBy("suffix", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@register("jon05_semi_join", with_views("f p", "SELECT file_id, path FROM f WHERE file_id IN (SELECT file_id FROM p WHERE import_count > 3)"))
def jon05(spark: SparkSession, d: str) -> DataFrame:
    many = T.parses(spark, d).where("import_count > 3").select("file_id")
    return T.files(spark, d).join(many, "file_id", "left_semi").select("file_id", "path")


@register("jon07_left_default", with_views("f p", "SELECT f.file_id, coalesce(p.symbol_count, 0) AS symbol_count, p.file_id IS NULL AS unparsed FROM f LEFT JOIN p USING (file_id)"))
def jon07(spark: SparkSession, d: str) -> DataFrame:
    parsed = T.parses(spark, d).select("file_id", "symbol_count", F.lit(True).alias("known"))
    rows = T.files(spark, d).select("file_id").join(parsed, "file_id", "left")
    return rows.select("file_id", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.col("known").isNull().alias("unparsed"))


@register("jon09_line_in_symbol", with_views("c s m", """
SELECT s.symbol_id, CAST(count(*) AS BIGINT) AS lines_inside FROM s JOIN m ON m.file_id = s.file_id AND m.line_number BETWEEN s.start_line AND s.end_line GROUP BY ALL"""))
def jon09(spark: SparkSession, d: str) -> DataFrame:
    symbols = T.symbols(spark, d).select("symbol_id", "file_id", "start_line", "end_line")
    hits = symbols.join(T.imports(spark, d).select("file_id", "line_number"), "file_id").where(F.col("line_number").between(F.col("start_line"), F.col("end_line")))
    return hits.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("lines_inside"))


@register("jon10_interval_overlap", with_views("c", """
SELECT a.chunk_id AS left_id, b.chunk_id AS right_id, CAST(least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1 AS BIGINT) AS shared_lines
FROM c a JOIN c b ON a.file_id = b.file_id AND a.chunk_id < b.chunk_id AND a.start_line <= b.end_line AND b.start_line <= a.end_line"""))
def jon10(spark: SparkSession, d: str) -> DataFrame:
    side = lambda p: T.chunks(spark, d).select("file_id", *[F.col(c).alias(f"{p}_{c}") for c in ("chunk_id", "start_line", "end_line")])
    meet = (F.col("a_chunk_id") < F.col("b_chunk_id")) & (F.col("a_start_line") <= F.col("b_end_line")) & (F.col("b_start_line") <= F.col("a_end_line"))
    pairs = side("a").join(side("b"), "file_id").where(meet)
    shared = F.least("a_end_line", "b_end_line") - F.greatest("a_start_line", "b_start_line") + 1
    return pairs.select(F.col("a_chunk_id").alias("left_id"), F.col("b_chunk_id").alias("right_id"), shared.cast("long").alias("shared_lines"))


@register("agg01_structure_summary", with_views("c s f m i", f"""
WITH {_RESOLVED}, ids AS (SELECT project_id FROM s UNION SELECT project_id FROM r UNION SELECT project_id FROM i)
SELECT ids.project_id, (SELECT count(*) FROM s WHERE s.project_id = ids.project_id) AS symbols, (SELECT count(*) FROM s WHERE s.project_id = ids.project_id AND kind IN ('class', 'interface')) AS classes,
  (SELECT count(*) FROM s WHERE s.project_id = ids.project_id AND kind IN ('function', 'method')) AS functions, (SELECT count(*) FROM r WHERE r.project_id = ids.project_id) AS imports,
  (SELECT count(resolved_file_id) FROM r WHERE r.project_id = ids.project_id) AS resolved, (SELECT count(*) FROM i WHERE i.project_id = ids.project_id) AS issues FROM ids"""))
def agg01(spark: SparkSession, d: str) -> DataFrame:
    return O.structure_summary(T.symbols(spark, d), O.resolve_imports(T.imports(spark, d), T.files(spark, d)), T.issues(spark, d))


_HEALTH = """h AS (SELECT project_id, count(*) AS chunks, CAST(max(chunk_id) AS BIGINT) AS max_id, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars,
  count(*) FILTER (WHERE end_line - start_line + 1 > 80) AS oversized FROM c GROUP BY project_id)"""


@register("agg02_index_health", with_views("c", f"WITH {_HEALTH} SELECT * FROM h"))
def agg02(spark: SparkSession, d: str) -> DataFrame:
    return index_health(T.chunks(spark, d))


def index_health(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_id").alias("max_id"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.count_if(F.col("end_line") - F.col("start_line") + 1 > 80).alias("oversized")
    )


@register("txt07_stale_index", with_views("c", f"WITH {_HEALTH} SELECT project_id, chunks = 0 OR chars > chunks * 16000 OR oversized > 0 AS stale FROM h"))
def txt07(spark: SparkSession, d: str) -> DataFrame:
    return index_health(T.chunks(spark, d)).select("project_id", ((F.col("chunks") == 0) | (F.col("chars") > F.col("chunks") * 16_000) | (F.col("oversized") > 0)).alias("stale"))


@register("agg04_distinct_issue_files", with_views("p i", "SELECT DISTINCT project_id, file_id FROM i"))
def agg04(spark: SparkSession, d: str) -> DataFrame:
    return T.issues(spark, d).select("project_id", "file_id").distinct()


_LANG = "CASE suffix WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.go' THEN 'Go' WHEN '.java' THEN 'Java' WHEN '.sql' THEN 'SQL' WHEN '.css' THEN 'CSS' END"


@register("agg07_primary_language", with_views("f", f"""
WITH t AS (SELECT project_id, {_LANG} AS language, sum(line_count) AS lines, min(path) AS first_path FROM f GROUP BY ALL)
SELECT project_id, language AS primary_language, CAST(lines AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY lines DESC, first_path) AS rn FROM t WHERE language IS NOT NULL) WHERE rn = 1"""))
def agg07(spark: SparkSession, d: str) -> DataFrame:
    return O.primary_language(T.files(spark, d), S.language_of(F.col("suffix")))


@register("agg08_imports_per_file", with_views("m", """
SELECT file_id, count(*) AS imports, count(DISTINCT target_module) AS modules, CAST(min(line_number) AS BIGINT) AS first_line, CAST(max(line_number) AS BIGINT) AS last_line FROM m GROUP BY ALL"""))
def agg08(spark: SparkSession, d: str) -> DataFrame:
    rows = T.imports(spark, d).groupBy("file_id")
    return rows.agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("target_module").alias("modules"), _long(F.min("line_number")).alias("first_line"), _long(F.max("line_number")).alias("last_line"))


@register("agg14_parse_coverage", with_views("f src p", """
WITH t AS (SELECT f.project_id, f.suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx') AS supported,
  f.suffix IN ('.py', '.js', '.jsx', '.ts', '.tsx') AND NOT coalesce(p.has_syntax_errors, false) AND coalesce(f.size_bytes, 0) <= 2097152 AS usable FROM f LEFT JOIN p USING (file_id))
SELECT project_id, count(*) AS source_files, count_if(supported) AS supported_files, count_if(usable) AS analysed_files, round(count_if(usable) / count(*), 4) AS ratio,
  CASE WHEN count_if(usable) / count(*) >= 0.8 THEN 'high' WHEN count_if(usable) > 0 THEN 'partial' ELSE 'limited' END AS level FROM t GROUP BY project_id"""))
def agg14(spark: SparkSession, d: str) -> DataFrame:
    rows = T.files(spark, d).join(T.parses(spark, d).select("file_id", "has_syntax_errors"), "file_id", "left")
    known = O.supported(F.col("suffix"))
    usable = known & ~F.coalesce("has_syntax_errors", F.lit(False)) & (F.coalesce("size_bytes", F.lit(0)) <= 2 << 20)
    t = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("source_files"), F.count_if(known).alias("supported_files"), F.count_if(usable).alias("analysed_files"))
    ratio = F.col("analysed_files") / F.col("source_files")
    return t.withColumn("ratio", F.round(ratio, 4)).withColumn("level", F.when(ratio >= 0.8, "high").when(F.col("analysed_files") > 0, "partial").otherwise("limited"))


@register("agg16_classification_confidence", with_views("f m", rf"""
WITH {_INDEX}, {_ROOTS}, t AS (SELECT m.*, CASE WHEN suffix = '.py' THEN string_split(regexp_replace(lower(target_module), '^\.+', ''), '.')[1] ELSE string_split(lower(target_module), '/')[1] END AS root FROM m),
k AS (SELECT t.project_id, regexp_matches(target_module, '^[./]') OR roots.root IS NOT NULL AS unresolved FROM t LEFT JOIN roots ON roots.project_id = t.project_id AND roots.root = t.root)
SELECT project_id, round(100.0 * count_if(NOT unresolved) / count(*), 1) AS confidence FROM k GROUP BY project_id"""))
def agg16(spark: SparkSession, d: str) -> DataFrame:
    marked = O.classify_unresolved(T.imports(spark, d), O.module_roots(T.files(spark, d)))
    known = F.count_if(F.col("target_class") == "likely_external")
    return marked.groupBy("project_id").agg(F.round(known * 100.0 / F.count(F.lit(1)), 1).alias("confidence"))


@register("agg17_percentiles", """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    read_table(spark, d, "events").createOrReplaceTempView("repolith_events")
    return spark.sql("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM repolith_events GROUP BY event_type")


@register("agg19_repository_scale", with_views("f", """
SELECT project_id, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CASE WHEN count(*) >= 500 OR sum(line_count) >= 100000 THEN 'large' WHEN count(*) >= 80 OR sum(line_count) >= 15000 THEN 'medium' ELSE 'small' END AS scale FROM f GROUP BY project_id"""))
def agg19(spark: SparkSession, d: str) -> DataFrame:
    t = T.files(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))
    return t.withColumn("scale", S.repository_scale(F.col("files"), F.col("lines")))


@register("win01_total_over", with_views("p i", """
SELECT *, (SELECT count(*) FROM i) AS total FROM (SELECT project_id, file_id FROM i ORDER BY project_id, file_id LIMIT 50)"""))
def win01(spark: SparkSession, d: str) -> DataFrame:
    return O.page(T.issues(spark, d).select("project_id", "file_id"), ["project_id", "file_id"], offset=0, limit=50).drop("has_more")


@register("win05_coverage_first", with_views("c", """
SELECT chunk_id, rn > 1 AS again FROM (SELECT chunk_id, project_id, row_number() OVER (PARTITION BY file_id ORDER BY kind, start_line NULLS LAST, chunk_id) AS rn FROM c)"""))
def win05(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("file_id").orderBy("kind", F.col("start_line").asc_nulls_last(), "chunk_id")
    return T.chunks(spark, d).select("chunk_id", (F.row_number().over(line) > 1).alias("again"))


@register("win06_merged_intervals", with_views("c", """
WITH t AS (SELECT file_id, start_line, end_line, start_line > 1 + max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, chunk_id FROM c WHERE start_line IS NOT NULL AND end_line >= start_line),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM t)
SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS merged FROM g GROUP BY file_id, island"""))
def win06(spark: SparkSession, d: str) -> DataFrame:
    return merged_intervals(T.chunks(spark, d))


def merged_intervals(chunks: DataFrame) -> DataFrame:
    """Overlapping and touching line ranges of a file as one range each."""
    order = Window.partitionBy("file_id").orderBy("start_line", "end_line", "chunk_id")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.where("start_line is not null and end_line >= start_line").withColumn("fresh", F.coalesce(F.col("start_line") > reach + 1, F.lit(True)))
    islands = rows.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("merged")).drop("island")


@register("txt03_uncovered_ranges", with_views("c f", """
WITH t AS (SELECT file_id, start_line, end_line, start_line > 1 + max(end_line) OVER w AS gap, chunk_id FROM c WHERE start_line IS NOT NULL AND end_line >= start_line WINDOW w AS (PARTITION BY file_id ORDER BY start_line, end_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM t),
k AS (SELECT file_id, min(start_line) AS a, max(end_line) AS b FROM g GROUP BY file_id, island),
u AS (SELECT file_id, coalesce(lag(b) OVER (PARTITION BY file_id ORDER BY a), 0) + 1 AS start_line, a - 1 AS end_line FROM k UNION ALL SELECT k.file_id, max(b) + 1, any_value(f.line_count) FROM k JOIN f USING (file_id) GROUP BY k.file_id)
SELECT * FROM u WHERE end_line >= start_line"""))
def txt03(spark: SparkSession, d: str) -> DataFrame:
    covered = merged_intervals(T.chunks(spark, d))
    line = Window.partitionBy("file_id").orderBy("start_line")
    before = covered.select("file_id", (F.coalesce(F.lag("end_line").over(line), F.lit(0)) + 1).alias("a"), (F.col("start_line") - 1).alias("b"))
    after = covered.groupBy("file_id").agg((F.max("end_line") + 1).alias("a")).join(T.files(spark, d).select("file_id", F.col("line_count").alias("b")), "file_id")
    return before.unionByName(after).where("b >= a").select("file_id", F.col("a").alias("start_line"), F.col("b").alias("end_line"))


@register("srt01_symbol_page", with_views("c s f", """
SELECT t.*, (SELECT count(*) FROM s JOIN f USING (file_id) WHERE s.kind = 'method') AS total FROM (
  SELECT s.symbol_id, f.path, CAST(s.start_line AS BIGINT) AS start_line FROM s JOIN f USING (file_id) WHERE s.kind = 'method' ORDER BY f.path, s.start_line NULLS FIRST, s.symbol_id LIMIT 50 OFFSET 100) t"""))
def srt01(spark: SparkSession, d: str) -> DataFrame:
    rows = T.symbols(spark, d).where("kind = 'method'").join(T.files(spark, d).select("file_id", "path"), "file_id").select("symbol_id", "path", _long("start_line").alias("start_line"))
    return O.page(rows, ["path", "start_line", "symbol_id"], offset=100, limit=50).drop("has_more")


@register("srt02_import_page", with_views("m", """
SELECT source_path, CAST(line_number AS BIGINT) AS line_number, target_module, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 250 AS has_more FROM m ORDER BY source_path, line_number, target_module, file_id LIMIT 50 OFFSET 200"""))
def srt02(spark: SparkSession, d: str) -> DataFrame:
    rows = T.imports(spark, d).select("source_path", _long("line_number").alias("line_number"), "target_module", "file_id")
    return O.page(rows, ["source_path", "line_number", "target_module", "file_id"], offset=200, limit=50).drop("file_id")


@register("srt03_issue_page", with_views("f p i", """
SELECT f.path, i.issue_id, (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM i) > 40 AS has_more FROM i JOIN f USING (file_id) ORDER BY f.path, i.issue_id LIMIT 40"""))
def srt03(spark: SparkSession, d: str) -> DataFrame:
    rows = T.issues(spark, d).join(T.files(spark, d).select("file_id", "path"), "file_id").select("path", "issue_id")
    return O.page(rows, ["path", "issue_id"], offset=0, limit=40)


@register("srt07_target_ranking", with_views("f", """
SELECT file_id, path, lower(path) = 'scripts/open_vessel.py' AS exact, starts_with(lower(path), 'scripts/open') AS prefix FROM f WHERE contains(lower(path), 'open')
ORDER BY exact DESC, prefix DESC, length(path), path, file_id LIMIT 60"""))
def srt07(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("path")
    rows = T.files(spark, d).where(low.contains("open")).select("file_id", "path", (low == "scripts/open_vessel.py").alias("exact"), low.startswith("scripts/open").alias("prefix"))
    return rows.orderBy(F.col("exact").desc(), F.col("prefix").desc(), F.length("path"), "path", "file_id").limit(60)


@register("imp01_target_search", with_views("c s f", """
WITH t AS (SELECT 'symbol' AS target, symbol_id AS id, lower(name) = 'load_queue' AS exact, starts_with(lower(name), 'load') AS prefix, length(name) AS size, name AS label FROM s WHERE contains(lower(name), 'load')
  UNION ALL SELECT 'file', file_id, lower(path) = 'load_queue', starts_with(lower(path), 'load'), length(path), path FROM f WHERE contains(lower(path), 'load'))
SELECT target, id, label FROM t ORDER BY exact DESC, prefix DESC, size, label, target, id LIMIT 30"""))
def imp01(spark: SparkSession, d: str) -> DataFrame:
    def side(df: DataFrame, kind: str, key: str, label: str) -> DataFrame:
        low = F.lower(label)
        return df.where(low.contains("load")).select(F.lit(kind).alias("target"), F.col(key).alias("id"), (low == "load_queue").alias("exact"), low.startswith("load").alias("prefix"), F.length(label).alias("size"), F.col(label).alias("label"))

    both = side(T.symbols(spark, d), "symbol", "symbol_id", "name").unionByName(side(T.files(spark, d), "file", "file_id", "path"))
    return both.orderBy(F.col("exact").desc(), F.col("prefix").desc(), "size", "label", "target", "id").limit(30).select("target", "id", "label")


@register("srt16_head_tail", with_views("c", """
WITH t AS (SELECT chunk_id, file_id, octet_length(encode(content)) AS bytes, row_number() OVER (PARTITION BY project_id ORDER BY file_id, start_line NULLS FIRST, chunk_id) AS a,
  row_number() OVER (PARTITION BY project_id ORDER BY file_id DESC, start_line DESC NULLS LAST, chunk_id DESC) AS b FROM c WHERE content IS NOT NULL)
SELECT chunk_id, CAST(bytes AS BIGINT) AS bytes FROM t WHERE a <= 120 OR b <= 120"""))
def srt16(spark: SparkSession, d: str) -> DataFrame:
    head = Window.partitionBy("project_id").orderBy("file_id", "start_line", "chunk_id")
    tail = Window.partitionBy("project_id").orderBy(F.col("file_id").desc(), F.col("start_line").desc(), F.col("chunk_id").desc())
    rows = T.chunks(spark, d).where("content is not null").select("project_id", "file_id", "start_line", "chunk_id", F.octet_length("content").cast("long").alias("bytes"))
    return rows.withColumn("a", F.row_number().over(head)).withColumn("b", F.row_number().over(tail)).where("a <= 120 or b <= 120").select("chunk_id", "bytes")


_TREE = """t AS (SELECT project_id, path FROM f),
d AS (SELECT project_id, true AS is_dir, string_split(path, '/')[1] AS name, count(*) AS file_count FROM t WHERE contains(path, '/') GROUP BY ALL
  UNION ALL SELECT project_id, false, path, 1 FROM t WHERE NOT contains(path, '/'))"""


@register("ftr01_directory_listing", with_views("f", f"WITH {_TREE} SELECT project_id, is_dir, name, file_count, sum(file_count) OVER (PARTITION BY project_id)::BIGINT AS total_files, count(*) OVER (PARTITION BY project_id) AS total_items FROM d"))
def ftr01(spark: SparkSession, d: str) -> DataFrame:
    listed = O.list_directory(T.files(spark, d)).drop("file_id")
    totals = listed.groupBy("project_id").agg(F.sum("file_count").alias("total_files"), F.count(F.lit(1)).alias("total_items"))
    return listed.join(totals, "project_id")


@register("set01_union_all", with_views("f", f"WITH {_TREE} SELECT is_dir, count(*) AS items FROM d GROUP BY ALL"))
def set01(spark: SparkSession, d: str) -> DataFrame:
    return O.list_directory(T.files(spark, d)).groupBy("is_dir").agg(F.count(F.lit(1)).alias("items"))


@register("agg03_children", with_views("f", """
SELECT project_id, string_split(substr(path, 5), '/')[1] AS child, count(*) AS files FROM f WHERE starts_with(path, 'src/') AND contains(substr(path, 5), '/') GROUP BY ALL"""))
def agg03(spark: SparkSession, d: str) -> DataFrame:
    listed = O.list_directory(T.files(spark, d), "src/").where("is_dir")
    return listed.select("project_id", F.col("name").alias("child"), F.col("file_count").alias("files"))


@register("srt12_tree_order", with_views("f", f"WITH {_TREE} SELECT project_id, name, CAST(row_number() OVER (PARTITION BY project_id ORDER BY is_dir DESC, lower(name), name, file_count) AS BIGINT) AS position FROM d"))
def srt12(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("project_id").orderBy(F.col("is_dir").desc(), F.lower("name"), "name", "file_count")
    return O.list_directory(T.files(spark, d)).select("project_id", "name", F.row_number().over(line).cast("long").alias("position"))


@register("fn04_byte_lengths", with_views("c", "SELECT chunk_id, CAST(strlen(content) AS BIGINT) AS bytes, CAST(length(content) AS BIGINT) AS chars FROM c WHERE content IS NOT NULL"))
def fn04(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where("content is not null").select("chunk_id", F.octet_length("content").cast("long").alias("bytes"), F.length("content").cast("long").alias("chars"))


@register("fn06_storage_key", with_views("f", "SELECT file_id, substr(sha256(path), 1, 12) AS storage_key FROM f"))
def fn06(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("file_id", F.substring(F.sha2("path", 256), 1, 12).alias("storage_key"))


@register("fn23_preview", with_views("c", r"""
WITH t AS (SELECT chunk_id, list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1] AS l FROM c WHERE content IS NOT NULL)
SELECT chunk_id, substr(coalesce(l, 'No source'), 1, 157) || CASE WHEN length(l) > 157 THEN '...' ELSE '' END AS preview FROM t"""))
def fn23(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where("content is not null").select("chunk_id", S.collapsed_first_line(F.col("content")).alias("preview"))


@register("fn25_markdown_cell", with_views("c", r"SELECT DISTINCT symbol_name, replace(regexp_replace(symbol_name, '[\r\n]+', ' ', 'g'), '|', '\|') AS cell FROM c WHERE symbol_name IS NOT NULL"))
def fn25(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where("symbol_name is not null").select("symbol_name", S.markdown_cell(F.col("symbol_name")).alias("cell")).distinct()


@register("fn27_project_name", r"SELECT DISTINCT source_filename, trim(regexp_replace(regexp_replace(source_filename, '\.(zip|tar\.gz|tgz)$', '', 'i'), '[^A-Za-z0-9_\- ]+', ' ', 'g')) AS name FROM projects WHERE source_filename IS NOT NULL")
def fn27(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("source_filename", r"(?i)\.(zip|tar\.gz|tgz)$", "")
    return read_table(spark, d, "projects").where("source_filename is not null").select("source_filename", F.trim(F.regexp_replace(bare, r"[^A-Za-z0-9_\- ]+", " ")).alias("name")).distinct()


@register("fn28_local_datetime", "SELECT project_id, snapshot_id, coalesce(strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M'), 'unknown') AS created FROM snapshots")
def fn28(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "snapshots").select("project_id", "snapshot_id", F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("unknown")).alias("created"))


@register("fn30_path_parts", with_views("f", r"SELECT file_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, string_split(path, '/')[-1] AS name, suffix FROM f"))
def fn30(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return T.files(spark, d).select("file_id", P.parent(path).alias("parent"), P.file_name(path).alias("name"), "suffix")


@register("fn31_package_root", with_views("m", """
SELECT DISTINCT target_module, CASE WHEN starts_with(target_module, '@') AND contains(target_module, '/') THEN string_split(target_module, '/')[1] || '/' || string_split(target_module, '/')[2] ELSE string_split(target_module, '/')[1] END AS package FROM m WHERE suffix <> '.py'"""))
def fn31(spark: SparkSession, d: str) -> DataFrame:
    return T.imports(spark, d).where("suffix <> '.py'").select("target_module", P.package_root(F.col("target_module")).alias("package")).distinct()


@register("udf01_unicode_lower", "SELECT doc_id, lower(text) AS folded FROM documents WHERE text IS NOT NULL AND lang = 'de'")
def udf01(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null and lang = 'de'").select("doc_id", F.lower("text").alias("folded"))


@register("jon11_full_outer_sets", """
WITH n AS (SELECT file_id, max_by(content_hash, modified_time_ns) AS h FROM files GROUP BY 1), o AS (SELECT file_id, min_by(content_hash, modified_time_ns) AS h FROM files GROUP BY 1 HAVING count(DISTINCT modified_time_ns) > 1)
SELECT CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'deleted' WHEN n.h = o.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS files FROM n FULL JOIN o USING (file_id) GROUP BY ALL""")
def jon11(spark: SparkSession, d: str) -> DataFrame:
    from repolith.operators.incremental import classify_changes

    raw = read_table(spark, d, "files").groupBy("file_id")
    now = raw.agg(F.max_by("content_hash", "modified_time_ns").alias("content_hash"))
    old = raw.agg(F.min_by("content_hash", "modified_time_ns").alias("content_hash"), F.count_distinct("modified_time_ns").alias("n")).where("n > 1").drop("n")
    return classify_changes(old, now, ["file_id"]).groupBy("state").agg(F.count(F.lit(1)).alias("files"))
