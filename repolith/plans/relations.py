"""Queries for the remaining relational operators: joins, sets, orders, scalars, evidence suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import graph as G
from repolith.operators import structure as O
from repolith.operators.snapshot_changes import snapshot_changes
from repolith.plans.graph import _CLOSURE, _FINDINGS, findings
from repolith.plans.problems import P1_SQL
from repolith.plans.registry import register
from repolith.plans.search import _TOKENS
from repolith.plans.structure import _RESOLVED
from repolith.plans.views import with_views
from repolith.runtime import read_table
from repolith.sources import tables as T


@register("flt09_optional_filters", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT rule_id, file_id, CAST(start_line AS BIGINT) AS start_line FROM fnd WHERE severity = 'error' AND scope = 'production'"))
def flt09(spark: SparkSession, d: str) -> DataFrame:
    return filtered_findings(findings(spark, d), severity="error", scope="production").select("rule_id", "file_id", F.col("start_line").cast("long").alias("start_line"))


def filtered_findings(found: DataFrame, *, severity: str | None = None, rule: str | None = None, scope: str | None = None) -> DataFrame:
    """Only the filters that are set take part in the plan."""
    for column, value in (("severity", severity), ("rule_id", rule), ("scope", scope)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


@register("qlt09_quality_page", with_views("f fs c s m", f"""
WITH {_FINDINGS} SELECT rule_id, file_id, CAST(start_line AS BIGINT) AS start_line, (SELECT count(*) FROM fnd WHERE rule_id = 'LONG_FUNCTION') AS total FROM fnd WHERE rule_id = 'LONG_FUNCTION' ORDER BY file_id, start_line NULLS FIRST, metric LIMIT 100 OFFSET 50"""))
def qlt09(spark: SparkSession, d: str) -> DataFrame:
    rows = filtered_findings(findings(spark, d), rule="LONG_FUNCTION").select("rule_id", "file_id", F.col("start_line").cast("long").alias("start_line"), "metric")
    return O.page(rows, ["file_id", "start_line", "metric"], offset=50, limit=100).drop("metric", "has_more")


for _rule, _name in (("LONG_FUNCTION", "qlt03_long_functions"), ("LARGE_CLASS", "qlt04_large_classes"), ("TOO_MANY_IMPORTS", "qlt05_too_many_imports")):

    def _by_rule(spark: SparkSession, d: str, rule: str = _rule) -> DataFrame:
        return filtered_findings(findings(spark, d), rule=rule).select("file_id", "severity", F.col("metric").cast("long").alias("metric"))

    register(_name, with_views("f fs c s m", f"WITH {_FINDINGS} SELECT file_id, severity, CAST(metric AS BIGINT) AS metric FROM fnd WHERE rule_id = '{_rule}'"))(_by_rule)


@register("qlt06_high_fan_out", with_views("e", "SELECT graph_id, src AS node, CASE WHEN count(DISTINCT dst) > 4 THEN 'error' ELSE 'warning' END AS severity, count(DISTINCT dst) AS metric FROM e GROUP BY ALL HAVING count(DISTINCT dst) > 2"))
def qlt06(spark: SparkSession, d: str) -> DataFrame:
    rows = T.edges(spark, d).groupBy("graph_id", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("metric")).where("metric > 2")
    return rows.withColumn("severity", S.severity(F.col("metric"), 2, 2))


@register("qlt08_finding_ids", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT rule_id || ':' || file_id || ':' || coalesce(CAST(start_line AS VARCHAR), '0') AS id, count(*) AS n FROM fnd GROUP BY ALL"))
def qlt08(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", "rule_id", F.col("file_id").cast("string"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")))
    return findings(spark, d).groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"))


@register("jon03_resolved_imports", with_views("f m", f"WITH {_RESOLVED} SELECT r.file_id, f.path AS target_path, CAST(line_number AS BIGINT) AS line_number FROM r JOIN f ON f.file_id = r.resolved_file_id"))
def jon03(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d)
    resolved = O.resolve_imports(T.imports(spark, d), files).where("resolved_file_id is not null")
    return resolved.join(files.select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("target_path")), "resolved_file_id").select("file_id", "target_path", F.col("line_number").cast("long").alias("line_number"))


@register("jon04_or_membership", with_views("f m", f"""
WITH {_RESOLVED}, k AS (SELECT file_id FROM f WHERE starts_with(path, 'app/services/')) SELECT file_id, target_module, CAST(line_number AS BIGINT) AS line_number FROM r WHERE file_id IN (SELECT file_id FROM k) OR resolved_file_id IN (SELECT file_id FROM k)"""))
def jon04(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d)
    wanted = files.where(F.col("path").startswith("app/services/")).select("file_id")
    rows = O.resolve_imports(T.imports(spark, d), files)
    as_target = wanted.withColumnRenamed("file_id", "resolved_file_id").withColumn("t", F.lit(True))
    marked = rows.join(wanted.withColumn("s", F.lit(True)), "file_id", "left").join(as_target, "resolved_file_id", "left").where("s or t")
    return marked.select("file_id", "target_module", F.col("line_number").cast("long").alias("line_number"))


@register("jon06_point_join", with_views("f", "SELECT p.project_id, f.file_id, f.path FROM (SELECT DISTINCT project_id FROM projects) p JOIN f ON f.project_id = p.project_id WHERE f.path = 'src/lib/index.ts' OR ends_with(f.path, '.toml')"))
def jon06(spark: SparkSession, d: str) -> DataFrame:
    projects = read_table(spark, d, "projects").select("project_id").distinct()
    wanted = T.files(spark, d).where((F.col("path") == "src/lib/index.ts") | F.col("path").endswith(".toml"))
    return wanted.join(projects, "project_id").select("project_id", "file_id", "path")


@register("jon13_vocabulary", with_views("c", f"""
WITH t AS (SELECT chunk_id, unnest({_TOKENS.format(text='content')}) AS term FROM c WHERE content IS NOT NULL), q AS (SELECT unnest(['shuttle', 'index', 'session']) AS term)
SELECT chunk_id, term, count(*) AS tf FROM t JOIN q USING (term) GROUP BY ALL"""))
def jon13(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("shuttle"), F.lit("index"), F.lit("session"))  # the words of one question
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", F.explode(F.filter(S.code_tokens(F.col("content")), lambda t: F.array_contains(wanted, t))).alias("term"))
    return rows.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@register("jon15_two_hop_frontier", with_views("e", """
WITH d AS (SELECT DISTINCT graph_id, src, dst FROM e), s AS (SELECT graph_id, min(src) AS node FROM d GROUP BY 1), h1 AS (SELECT DISTINCT d.graph_id, d.dst AS node FROM d JOIN s ON s.graph_id = d.graph_id AND s.node = d.src WHERE d.dst <> s.node),
h2 AS (SELECT DISTINCT d.graph_id, d.dst AS node FROM d JOIN h1 ON h1.graph_id = d.graph_id AND h1.node = d.src WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.graph_id = d.graph_id AND x.node = d.dst) AND NOT EXISTS (SELECT 1 FROM s WHERE s.graph_id = d.graph_id AND s.node = d.dst))
SELECT graph_id, node, 1 AS depth FROM h1 UNION ALL SELECT graph_id, node, 2 FROM h2"""))
def jon15(spark: SparkSession, d: str) -> DataFrame:
    once = T.edges(spark, d).select("graph_id", "src", "dst").distinct()
    seeds = once.groupBy("graph_id").agg(F.min("src").alias("node"))
    step = lambda frontier: once.join(frontier.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node")).distinct()
    one = step(seeds).join(seeds, ["graph_id", "node"], "left_anti")
    two = step(one).join(seeds, ["graph_id", "node"], "left_anti").join(one, ["graph_id", "node"], "left_anti")
    return one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))


@register("win07_contiguous_lines", with_views("m", """
WITH t AS (SELECT DISTINCT file_id, line_number FROM m), g AS (SELECT *, line_number - row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS k FROM t)
SELECT file_id, CAST(min(line_number) AS BIGINT) AS start_line, CAST(max(line_number) AS BIGINT) AS end_line FROM g GROUP BY file_id, k"""))
def win07(spark: SparkSession, d: str) -> DataFrame:
    rows = T.imports(spark, d).select("file_id", F.col("line_number").cast("long").alias("n")).distinct()
    keyed = rows.withColumn("k", F.col("n") - F.row_number().over(Window.partitionBy("file_id").orderBy("n")))
    return keyed.groupBy("file_id", "k").agg(F.min("n").alias("start_line"), F.max("n").alias("end_line")).drop("k")


@register("win08_pool_ranks", with_views("c", """
SELECT kind AS pool, file_id AS item, CAST(row_number() OVER (PARTITION BY kind ORDER BY first, file_id) AS BIGINT) AS rank FROM (SELECT kind, file_id, min(chunk_id) AS first FROM c GROUP BY ALL)"""))
def win08(spark: SparkSession, d: str) -> DataFrame:
    first = T.chunks(spark, d).groupBy(F.col("kind").alias("pool"), F.col("file_id").alias("item")).agg(F.min("chunk_id").alias("first"))
    return first.select("pool", "item", F.row_number().over(Window.partitionBy("pool").orderBy("first", "item")).cast("long").alias("rank"))


@register("srt05_full_structure", with_views("c s f p i m", """
SELECT 'symbol' AS part, count(*) AS rows, min(path) AS first_path FROM s JOIN f USING (file_id) UNION ALL SELECT 'import', count(*), min(source_path) FROM m UNION ALL SELECT 'issue', count(*), min(path) FROM i JOIN f USING (file_id)"""))
def srt05(spark: SparkSession, d: str) -> DataFrame:
    paths = T.files(spark, d).select("file_id", "path")
    part = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("rows"), F.min("path").alias("first_path")).select(F.lit(name).alias("part"), "rows", "first_path")
    return part("symbol", T.symbols(spark, d).join(paths, "file_id")).unionByName(part("import", T.imports(spark, d).withColumnRenamed("source_path", "path"))).unionByName(part("issue", T.issues(spark, d).join(paths, "file_id")))


@register("srt11_report_priority", with_views("f fs c s m", f"""
WITH {_FINDINGS} SELECT scope, severity, f.path, CAST(start_line AS BIGINT) AS start_line FROM fnd JOIN f USING (file_id)
ORDER BY CASE scope WHEN 'production' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, CASE severity WHEN 'error' THEN 0 ELSE 1 END, f.path, start_line NULLS FIRST, rule_id LIMIT 60"""))
def srt11(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).join(T.files(spark, d).select("file_id", "path"), "file_id")
    scope = F.when(F.col("scope") == "production", 0).when(F.col("scope") == "test", 1).otherwise(2)
    return rows.orderBy(scope, F.when(F.col("severity") == "error", 0).otherwise(1), "path", "start_line", "rule_id").limit(60).select("scope", "severity", "path", F.col("start_line").cast("long").alias("start_line"))


@register("set03_snapshot_diff_counts", "SELECT project_id, snapshot_id, section, count(*) FILTER (WHERE change_kind = 'added') AS new_items, count(*) FILTER (WHERE change_kind = 'removed') AS fixed_items, count(*) FILTER (WHERE change_kind = 'changed') AS changed_items, count(*) > 100 AS truncated FROM (" + P1_SQL + ") GROUP BY ALL")
def set03(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("change_kind") == k)
    rows = snapshot_changes(read_table(spark, d, "snapshots")).groupBy("project_id", "snapshot_id", "section")
    return rows.agg(kind("added").alias("new_items"), kind("removed").alias("fixed_items"), kind("changed").alias("changed_items"), (F.count(F.lit(1)) > 100).alias("truncated"))


@register("set04_supplier_union", with_views("c s i", "SELECT 'symbol' AS source, file_id, name FROM s UNION ALL SELECT 'issue', file_id, NULL FROM i"))
def set04(spark: SparkSession, d: str) -> DataFrame:
    symbols = T.symbols(spark, d).select(F.lit("symbol").alias("source"), "file_id", "name")
    return symbols.unionByName(T.issues(spark, d).select(F.lit("issue").alias("source"), "file_id"), allowMissingColumns=True)


@register("set05_first_of_key", with_views("c", "SELECT file_id, symbol_name, min(chunk_id) AS chunk_id FROM c WHERE symbol_name IS NOT NULL GROUP BY ALL"))
def set05(spark: SparkSession, d: str) -> DataFrame:
    return T.newest(T.chunks(spark, d).where("symbol_name is not null"), ["file_id", "symbol_name"], "chunk_id").select("file_id", "symbol_name", "chunk_id")


@register("set06_merge_lines", with_views("m", "SELECT file_id, array_to_string(list_sort(list(DISTINCT line_number)), ',') AS lines, min_by(target_module, line_number) AS first_target FROM m GROUP BY file_id"))
def set06(spark: SparkSession, d: str) -> DataFrame:
    rows = T.imports(spark, d).groupBy("file_id")
    return rows.agg(F.array_join(F.sort_array(F.collect_set("line_number")).cast("array<string>"), ",").alias("lines"), F.min_by("target_module", "line_number").alias("first_target"))


@register("set08_ordered_unique", with_views("c", f"""
WITH t AS (SELECT chunk_id, {_TOKENS.format(text='symbol_name')} AS t FROM c WHERE symbol_name IS NOT NULL) SELECT chunk_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS words FROM t"""))
def set08(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where("symbol_name is not null").select("chunk_id", F.array_join(F.array_distinct(S.code_tokens(F.col("symbol_name"))), " ").alias("words"))


@register("fn02_string_scalars", with_views("f", "SELECT file_id, lower(path) AS low, CAST(length(path) AS BIGINT) AS size, substr(path, 2, 5) AS part, CAST(instr(path, '/') AS BIGINT) AS slash FROM f"))
def fn02(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return T.files(spark, d).select("file_id", F.lower(path).alias("low"), F.length(path).cast("long").alias("size"), F.substring(path, 2, 5).alias("part"), F.instr(path, "/").cast("long").alias("slash"))


@register("fn05_coalesce_case", "SELECT file_id, coalesce(symbol_count, 0) AS symbols, CASE WHEN has_syntax_errors THEN 'error' WHEN has_syntax_errors IS NULL THEN 'unknown' ELSE 'ok' END AS state, count(*) AS n FROM parse_results GROUP BY ALL")
def fn05(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("has_syntax_errors")
    rows = read_table(spark, d, "parse_results").select("file_id", F.coalesce("symbol_count", F.lit(0)).alias("symbols"), F.when(flag, "error").when(flag.isNull(), "unknown").otherwise("ok").alias("state"))
    return rows.groupBy("file_id", "symbols", "state").agg(F.count(F.lit(1)).alias("n"))


@register("fn08_bm25_terms", with_views("c", f"""
WITH t AS (SELECT chunk_id, project_id, {_TOKENS.format(text='content')} AS t FROM c WHERE content IS NOT NULL), z AS (SELECT project_id, count(*) AS n, avg(len(t)) AS a FROM t GROUP BY 1),
k AS (SELECT project_id, chunk_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'total')) AS tf FROM t), d AS (SELECT project_id, count(*) AS df FROM k WHERE tf > 0 GROUP BY 1)
SELECT chunk_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0))), 4) AS score FROM k JOIN z USING (project_id) JOIN d USING (project_id) WHERE tf > 0"""))
def fn08(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").select("project_id", "chunk_id", S.code_tokens(F.col("content")).alias("t"))
    rows = rows.select("project_id", "chunk_id", F.size("t").alias("dl"), F.size(F.filter("t", lambda x: x == "total")).alias("tf"))
    corpus = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a"), F.count_if(F.col("tf") > 0).alias("df"))
    scored = rows.where("tf > 0").join(corpus, "project_id")
    return scored.select("chunk_id", F.round(S.bm25(F.col("tf"), F.col("dl"), F.col("a"), F.col("n"), F.col("df")), 4).alias("score"))


@register("fn11_reference_points", with_views("f", "SELECT file_id, CASE WHEN line_count <= 0 THEN 0 ELSE greatest(1, CAST(round_even(8 * ln(1 + least(CAST(line_count AS DOUBLE), 200.0)) / ln(201.0), 0) AS INTEGER)) END AS points FROM f"))
def fn11(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).select("file_id", S.reference_points(F.col("line_count"), 200, 8).alias("points"))


@register("fn13_grades", with_views("pay", "SELECT snapshot_id, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT snapshot_id, CAST(data_json ->> '$.quality.score' AS DOUBLE) AS s FROM pay) WHERE s IS NOT NULL"))
def fn13(spark: SparkSession, d: str) -> DataFrame:
    rows = T.payloads(spark, d).select("snapshot_id", F.get_json_object("data_json", "$.quality.score").cast("double").alias("s")).where("s is not null")
    return rows.select("snapshot_id", S.grade(F.col("s")).alias("grade"))


@register("fn24_reference_check", r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\[(\d{1,6})\]', 1), lambda x: CAST(x AS BIGINT)) AS r FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(r) AS BIGINT) AS cited, CAST(len(list_filter(r, lambda x: x BETWEEN 1 AND 8)) AS BIGINT) AS valid FROM t WHERE len(r) > 0""")
def fn24(spark: SparkSession, d: str) -> DataFrame:
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("long"))
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", cited.alias("r")).where(F.size("r") > 0)
    return rows.select("doc_id", F.size("r").cast("long").alias("cited"), F.size(F.filter("r", lambda x: x.between(1, 8))).cast("long").alias("valid"))


@register("fn26_fence_stripping", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s*```[A-Za-z]*\n', ''), '\n```\s*$', '')) AS digest FROM documents WHERE text IS NOT NULL AND contains(text, '```')""")
def fn26(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("text", r"\A\s*```[A-Za-z]*\n", ""), r"\n```\s*\z", "")
    return read_table(spark, d, "documents").where("text is not null and contains(text, '```')").select("doc_id", F.md5(bare).alias("digest"))


@register("fn29_cycle_text", with_views("pay", """
WITH k AS (SELECT snapshot_id, CAST(unnest(json_extract(data_json, '$.dependency.cycles[*].paths')) AS VARCHAR[]) AS p FROM pay)
SELECT snapshot_id, array_to_string(p[1:6], ' > ') || CASE WHEN len(p) > 8 THEN ' > ...' ELSE CASE WHEN len(p) > 6 THEN ' > ' || array_to_string(p[7:8], ' > ') ELSE '' END END AS cycle, count(*) AS n FROM k WHERE len(p) > 0 GROUP BY ALL"""))
def fn29(spark: SparkSession, d: str) -> DataFrame:
    cycles = T.payloads(spark, d).select("snapshot_id", F.explode(F.from_json("data_json", T._CYCLES)["dependency"]["cycles"]["paths"]).alias("p")).where(F.size("p") > 0)
    text = F.when(F.size("p") <= 8, F.array_join("p", " > ")).otherwise(F.concat(F.array_join(F.slice("p", 1, 6), " > "), F.lit(" > ...")))
    return cycles.groupBy("snapshot_id", text.alias("cycle")).agg(F.count(F.lit(1)).alias("n"))


@register("flt13_evidence_admission", with_views("c", """
SELECT chunk_id FROM c WHERE content IS NOT NULL AND (contains(lower(content), 'session') OR kind IN ('class', 'interface') OR (symbol_name IS NULL AND length(content) / 100.0 >= 14))"""))
def flt13(spark: SparkSession, d: str) -> DataFrame:
    named = F.lower("content").contains("session")
    admitted = named | F.col("kind").isin("class", "interface") | (F.col("symbol_name").isNull() & (F.length("content") / 100.0 >= 14))
    return T.chunks(spark, d).where("content is not null").where(admitted).select("chunk_id")


@register("flt14_target_guard", with_views("c", r"SELECT chunk_id FROM c WHERE content IS NOT NULL AND regexp_matches(lower(content), '(^|[^A-Za-z0-9_])limit([^A-Za-z0-9_]|$)')"))
def flt14(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).where("content is not null").where(F.lower("content").rlike(r"(^|[^A-Za-z0-9_])limit([^A-Za-z0-9_]|$)")).select("chunk_id")


@register("qa05_rewindow", with_views("c", r"""
WITH t AS (SELECT chunk_id, string_split(replace(content, chr(13), ''), chr(10)) AS l FROM c WHERE content IS NOT NULL), a AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: contains(x, 'return')), true), 1) AS pos FROM t)
SELECT chunk_id, CAST(greatest(1, pos - 8) AS BIGINT) AS first_line, md5(array_to_string(l[greatest(1, pos - 8) : greatest(1, pos - 8) + 23], chr(10))) AS digest FROM a"""))
def qa05(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n").alias("l"))
    found = F.array_position(F.transform("l", lambda x: x.contains("return")), True)
    start = F.greatest(F.lit(1), F.when(found == 0, 1).otherwise(found) - 8).cast("int")
    return rows.select("chunk_id", start.cast("long").alias("first_line"), F.md5(F.array_join(F.slice("l", start, F.lit(24)), "\n")).alias("digest"))


# Files that describe a project, most telling first.
_IMPORTANT = {
    "readme.md": 0, "readme": 0, "package.json": 1, "pyproject.toml": 2, "docker-compose.yml": 3, "docker-compose.yaml": 3, "compose.yml": 3, "compose.yaml": 3,
    "makefile": 4, "requirements.txt": 5, "vite.config.ts": 6, "vite.config.js": 6,
}


@register("qa06_important_files", with_views("f", f"""
WITH t AS (SELECT project_id, file_id, path, (map {{{", ".join(f"'{k}': {v}" for k, v in _IMPORTANT.items())}}})[lower(string_split(path, '/')[-1])] AS priority FROM f)
SELECT file_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY priority, length(path), path, file_id) AS rn FROM t WHERE priority IS NOT NULL) WHERE rn <= 8"""))
def qa06(spark: SparkSession, d: str) -> DataFrame:
    priority = F.create_map(*[F.lit(x) for pair in _IMPORTANT.items() for x in pair])[F.lower(F.element_at(F.split("path", "/"), -1))]
    rows = T.files(spark, d).withColumn("priority", priority).where("priority is not null")
    line = Window.partitionBy("project_id").orderBy("priority", F.length("path"), "path", "file_id")
    return rows.withColumn("rn", F.row_number().over(line)).where("rn <= 8").select("file_id", "priority")


@register("qa07_symbol_supplier")
def qa07(spark: SparkSession, d: str) -> DataFrame:
    """Exact, partial and fuzzy matches of a name, best kind first, at most 20 each per project."""
    from repolith.functions.similarity import gestalt_ratio

    symbols = T.symbols(spark, d)
    low = F.lower("name")
    ratio = gestalt_ratio(F.col("name"), F.lit("load_queue"))
    marked = symbols.withColumn("ratio", ratio).withColumn("source", F.when(low == "load_queue", "symbol_exact").when(low.contains("queue"), "symbol_match").when(F.col("ratio") >= 0.72, "symbol_fuzzy")).where("source is not null")
    line = Window.partitionBy("project_id", "source").orderBy(F.col("ratio").desc(), "symbol_id")
    score = F.when(F.col("source") == "symbol_exact", 30.0).otherwise(12.0 + 10.0 * F.coalesce("ratio", F.lit(0.6)))
    return marked.withColumn("n", F.row_number().over(line)).where("n <= 20").select("project_id", "symbol_id", "source", F.round(score, 4).alias("score"))


@register("qa08_focused_line", with_views("c", r"""
WITH l AS (SELECT chunk_id, n, (contains(x, 'total'))::INT * 4 + (contains(x, 'return'))::INT * 3 + regexp_matches(x, '\b[45]\d\d\b')::INT * 2 AS score FROM c, unnest(string_split(replace(content, chr(13), ''), chr(10))) WITH ORDINALITY AS t(x, n) WHERE content IS NOT NULL)
SELECT chunk_id, CAST(score AS BIGINT) AS score, CAST(n AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, n) AS rn FROM l) WHERE rn = 1"""))
def qa08(spark: SparkSession, d: str) -> DataFrame:
    """The line that speaks most for the question, found inside the row."""
    lines = F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")
    score = lambda x: x.contains("total").cast("int") * 4 + x.contains("return").cast("int") * 3 + x.rlike(r"\b[45]\d\d\b").cast("int") * 2
    best = F.array_max(F.transform(lines, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("n"))))
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", best.alias("b"))
    return rows.select("chunk_id", F.col("b.s").cast("long").alias("score"), (1 - F.col("b.n")).cast("long").alias("line"))


@register("qa11_citation_rank", with_views("c fs", """
WITH t AS (SELECT c.project_id, c.chunk_id, fs.path, c.start_line, least(25.0, length(content) / 100.0) + CASE fs.scope WHEN 'generated' THEN -60 WHEN 'test' THEN -28 ELSE 6 END + CASE WHEN c.symbol_name IS NOT NULL AND contains(lower(c.symbol_name), 'load') THEN 13 ELSE 0 END
  + CASE WHEN contains(lower(fs.path), 'load') THEN 9 ELSE 0 END + CASE WHEN contains(lower(content), 'load') THEN 6 ELSE 0 END - CASE WHEN NOT contains(lower(fs.path || content || coalesce(c.symbol_name, '')), 'load') THEN 12 ELSE 0 END AS score FROM c JOIN fs USING (file_id) WHERE content IS NOT NULL)
SELECT chunk_id, round(score, 4) AS score, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(score, 4) DESC, path, start_line NULLS FIRST, chunk_id) AS rn FROM t) WHERE rn <= 64"""))
def qa11(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d).select("file_id", "path", S.code_scope(F.col("path")).alias("scope"))
    has = lambda c: F.coalesce(F.lower(c).contains("load"), F.lit(False))
    scope = F.when(F.col("scope") == "generated", -60).when(F.col("scope") == "test", -28).otherwise(6)
    symbol, path, text = has("symbol_name"), has("path"), has("content")
    score = F.least(F.lit(25.0), F.length("content") / 100.0) + scope + symbol.cast("int") * 13 + path.cast("int") * 9 + text.cast("int") * 6 - (~(symbol | path | text)).cast("int") * 12
    rows = T.chunks(spark, d).where("content is not null").join(files, "file_id").withColumn("score", F.round(score, 4))
    line = Window.partitionBy("project_id").orderBy(F.col("score").desc(), "path", "start_line", "chunk_id")
    return rows.withColumn("place", F.row_number().over(line).cast("long")).where("place <= 64").select("chunk_id", "score", "place")


@register("qa13_stale_evidence", with_views("f src", "SELECT f.file_id, sha256(src.content) = f.content_hash AS fresh FROM f JOIN src USING (file_id)"))
def qa13(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file's text is still the one whose hash the scan recorded."""
    return T.files(spark, d).join(T.sources(spark, d), "file_id").select("file_id", (F.sha2("content", 256) == F.col("content_hash")).alias("fresh"))


@register("grf02_graph_snapshot", with_views("e", f"""
WITH {_CLOSURE} SELECT d.graph_id, count(*) AS edges, (SELECT count(DISTINCT component) FROM scc WHERE scc.graph_id = d.graph_id) AS cycles, (SELECT count(*) FROM scc WHERE scc.graph_id = d.graph_id) AS nodes_in_cycles FROM d GROUP BY d.graph_id""", recursive=True))
def grf02(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    groups = G.strongly_connected(edges).groupBy("graph_id").agg(F.count_distinct("component").alias("cycles"), F.count(F.lit(1)).alias("nodes_in_cycles"))
    return edges.select("graph_id", "src", "dst").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")).join(groups, "graph_id", "left").na.fill(0)


@register("imp08_recommendations", with_views("e", """
WITH d AS (SELECT DISTINCT graph_id, src, dst FROM e WHERE src <> dst), c AS (SELECT graph_id, dst AS node, count(*) AS callers FROM d GROUP BY ALL), u AS (SELECT graph_id, src AS node, count(*) AS deps FROM d GROUP BY ALL),
n AS (SELECT graph_id, node FROM c UNION SELECT graph_id, node FROM u), k AS (SELECT n.*, coalesce(callers, 0) AS callers, coalesce(deps, 0) AS deps FROM n LEFT JOIN c USING (graph_id, node) LEFT JOIN u USING (graph_id, node))
SELECT graph_id, node, 1 AS priority, 'review_callers' AS action FROM k WHERE callers > 0 UNION ALL SELECT graph_id, node, 2, 'check_contracts' FROM k WHERE deps > 1 UNION ALL SELECT graph_id, node, 3, 'add_tests' FROM k WHERE callers > 1"""))
def imp08(spark: SparkSession, d: str) -> DataFrame:
    apart = T.edges(spark, d).where("src <> dst").select("graph_id", "src", "dst").distinct()
    ends = G.degrees(apart)
    act = lambda on, priority, name: F.when(on, F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("action")))
    actions = F.array_compact(F.array(act(F.col("in_degree") > 0, 1, "review_callers"), act(F.col("out_degree") > 1, 2, "check_contracts"), act(F.col("in_degree") > 1, 3, "add_tests")))
    return ends.select("graph_id", "node", F.explode(actions).alias("a")).select("graph_id", "node", "a.priority", "a.action")


@register("imp02_impact_report", with_views("e", """
WITH d AS (SELECT DISTINCT graph_id, src, dst FROM e WHERE src <> dst), n AS (SELECT graph_id, src AS node FROM d UNION SELECT graph_id, dst FROM d)
SELECT n.graph_id, n.node, (SELECT count(*) FROM d WHERE d.graph_id = n.graph_id AND d.dst = n.node) AS direct_callers, (SELECT count(*) FROM d WHERE d.graph_id = n.graph_id AND d.src = n.node) AS dependencies,
  (SELECT count(DISTINCT b.src) FROM d a JOIN d b ON a.graph_id = b.graph_id AND b.dst = a.src WHERE a.graph_id = n.graph_id AND a.dst = n.node AND b.src <> n.node AND NOT EXISTS (SELECT 1 FROM d x WHERE x.graph_id = n.graph_id AND x.dst = n.node AND x.src = b.src)) AS indirect FROM n"""))
def imp02(spark: SparkSession, d: str) -> DataFrame:
    edges = T.edges(spark, d)
    ends = G.degrees(edges.where("src <> dst")).select("graph_id", "node", F.col("in_degree").alias("direct_callers"), F.col("out_degree").alias("dependencies"))
    far = G.two_hops(edges).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("indirect"))
    return ends.join(far, ["graph_id", "node"], "left").na.fill(0, ["indirect"])


@register("cal03_grouped_references", with_views("c s m", """
SELECT s.file_id, s.symbol_id, array_to_string(list_sort(list(DISTINCT m.line_number)), ',') AS lines FROM s JOIN m ON m.file_id = s.file_id AND m.line_number BETWEEN s.start_line AND s.end_line GROUP BY ALL"""))
def cal03(spark: SparkSession, d: str) -> DataFrame:
    hits = T.symbols(spark, d).select("symbol_id", "file_id", "start_line", "end_line").join(T.imports(spark, d).select("file_id", "line_number"), "file_id").where(F.col("line_number").between(F.col("start_line"), F.col("end_line")))
    return hits.groupBy("file_id", "symbol_id").agg(F.array_join(F.sort_array(F.collect_set("line_number")).cast("array<string>"), ",").alias("lines"))


@register("cal02_called_symbols", with_views("c s", r"""
WITH k AS (SELECT c.chunk_id, c.project_id, unnest(regexp_extract_all(content, '\b([A-Za-z_]\w*)\(', 1)) AS callee FROM c WHERE content IS NOT NULL AND kind IN ('function', 'method')),
u AS (SELECT project_id, name, min(symbol_id) AS symbol_id FROM s GROUP BY ALL HAVING count(*) = 1)
SELECT DISTINCT k.chunk_id AS caller_id, u.symbol_id AS callee_id FROM k JOIN u ON u.project_id = k.project_id AND u.name = k.callee WHERE u.symbol_id <> k.chunk_id"""))
def cal02(spark: SparkSession, d: str) -> DataFrame:
    calls = T.chunks(spark, d).where("content is not null and kind in ('function', 'method')").select(F.col("chunk_id").alias("caller_id"), "project_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1)))).alias("name"))
    unique = T.symbols(spark, d).groupBy("project_id", "name").agg(F.min("symbol_id").alias("callee_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return calls.join(unique, ["project_id", "name"]).where("callee_id <> caller_id").select("caller_id", "callee_id").distinct()


@register("prs01_parse")
def prs01(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, imports, calls and issues of every source file."""
    from repolith.operators.parsing import parse_files

    files = T.files(spark, d).select("project_id", "file_id", "suffix").join(T.sources(spark, d), "file_id")
    return parse_files(files).groupBy("row_type", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file_id").alias("files"))


@register("cal04_bound_calls")
def cal04(spark: SparkSession, d: str) -> DataFrame:
    from repolith.operators.parsing import bound_calls, parse_files

    files = T.files(spark, d)
    parsed = parse_files(files.select("project_id", "file_id", "suffix").join(T.sources(spark, d), "file_id"))
    return bound_calls(parsed, files, O.python_module_index(files))
