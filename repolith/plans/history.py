"""Queries over snapshots, incremental scans, questions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import evidence as E
from repolith.operators import incremental as I
from repolith.operators import snapshots as N
from repolith.plans.graph import _FINDINGS, findings
from repolith.plans.registry import register
from repolith.plans.views import with_views
from repolith.runtime import read_table
from repolith.sources import tables as T

_METRICS = ",\n  ".join(f"CAST(CAST(data_json ->> '{p}' AS DOUBLE) AS BIGINT) AS {n}" for n, p in N.METRICS.items()) + ",\n  " + ", ".join(f"data_json ->> '{p}' AS {n}" for n, p in N.CONTEXT.items())
_MET = f"met AS (SELECT project_id, snapshot_id, created_at, reason, {_METRICS} FROM pay)"
_PREV = "cmp AS (SELECT *, " + ", ".join(f"lag({n}) OVER w AS base_{n}" for n in [*N.METRICS, *N.CONTEXT, "snapshot_id"]) + " FROM met WINDOW w AS (PARTITION BY project_id ORDER BY created_at NULLS FIRST, snapshot_id))"
_WARN = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {n} IS DISTINCT FROM base_{n} THEN '{n} differs' END" for n in N.CONTEXT)
    + ", "
    + ", ".join(f"CASE WHEN {n} IS NULL OR base_{n} IS NULL THEN '{n} missing' END" for n in ("scoring_model", "parser_signature"))
    + ", CASE WHEN score IS NULL OR base_score IS NULL THEN 'score missing' END], lambda x: x IS NOT NULL)"
)


@register("snp01_metrics", with_views("pay", f"WITH {_MET} SELECT project_id, snapshot_id, score, total_findings, file_count, symbol_count, import_count, scoring_model FROM met"))
def snp01(spark: SparkSession, d: str) -> DataFrame:
    return N.snapshot_metrics(T.payloads(spark, d)).select("project_id", "snapshot_id", "score", "total_findings", "file_count", "symbol_count", "import_count", "scoring_model")


@register("snp02_deltas", with_views("pay", f"""
WITH {_MET}, {_PREV}, k AS (SELECT *, {_WARN} AS warnings FROM cmp WHERE base_snapshot_id IS NOT NULL)
SELECT project_id, snapshot_id, base_snapshot_id, file_count - base_file_count AS file_count_delta, CASE WHEN len(warnings) = 0 THEN score - base_score END AS score_delta,
  CASE WHEN len(warnings) = 0 THEN total_findings - base_total_findings END AS total_findings_delta, CASE WHEN len(warnings) = 0 THEN symbol_count - base_symbol_count END AS symbol_count_delta,
  CASE WHEN len(warnings) = 0 THEN import_count - base_import_count END AS import_count_delta FROM k"""))
def snp02(spark: SparkSession, d: str) -> DataFrame:
    return N.compared(N.snapshot_metrics(T.payloads(spark, d))).drop("warnings")


@register("snp03_comparability", with_views("pay", f"WITH {_MET}, {_PREV} SELECT project_id, snapshot_id, array_to_string({_WARN}, '; ') AS warnings FROM cmp WHERE base_snapshot_id IS NOT NULL"))
def snp03(spark: SparkSession, d: str) -> DataFrame:
    return N.compared(N.snapshot_metrics(T.payloads(spark, d))).select("project_id", "snapshot_id", F.array_join("warnings", "; ").alias("warnings"))


@register("snp04_rule_signature", with_views("f fs c s m", f"""
WITH {_FINDINGS} SELECT project_id, sha256('{{"rules":["' || array_to_string(list_sort(list(DISTINCT rule_id)), '","') || '"]}}') AS signature FROM fnd GROUP BY project_id"""))
def snp04(spark: SparkSession, d: str) -> DataFrame:
    return N.rule_signature(findings(spark, d))


@register("win09_latest_snapshot", with_views("pay", "SELECT project_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, snapshot_id DESC) AS rn FROM pay WHERE reason <> 'manual') WHERE rn = 1"))
def win09(spark: SparkSession, d: str) -> DataFrame:
    return T.newest(T.payloads(spark, d).where("reason <> 'manual'"), ["project_id"], F.col("created_at").desc_nulls_last(), F.col("snapshot_id").desc()).select("project_id", "snapshot_id")


@register("fn07_fingerprint", with_views("f", """SELECT file_id, sha256('{"path":"' || path || '","size":' || size_bytes || '}') AS fingerprint FROM f WHERE size_bytes IS NOT NULL AND NOT contains(path, '"')"""))
def fn07(spark: SparkSession, d: str) -> DataFrame:
    rows = T.files(spark, d).where("size_bytes is not null and not contains(path, '\"')")
    return rows.select("file_id", F.sha2(F.to_json(F.struct(F.col("path"), F.col("size_bytes").alias("size"))), 256).alias("fingerprint"))


@register("fn32_finding_key", with_views("f fs c s m", f"WITH {_FINDINGS} SELECT rule_id || '|' || f.path || '|' || coalesce(CAST(start_line AS VARCHAR), '0') AS key, count(*) AS findings FROM fnd JOIN f USING (file_id) GROUP BY ALL"))
def fn32(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d).join(T.files(spark, d).select("file_id", "path"), "file_id")
    return rows.groupBy(F.concat_ws("|", "rule_id", "path", F.coalesce(F.col("start_line").cast("string"), F.lit("0"))).alias("key")).agg(F.count(F.lit(1)).alias("findings"))


@register("fn34_json_or_empty", "SELECT snapshot_id, count(*) AS deliveries, CAST(sum(CASE WHEN json_valid(data_json) THEN coalesce(json_array_length(data_json, '$.quality.findings'), 0) ELSE 0 END) AS BIGINT) AS items FROM snapshots GROUP BY snapshot_id")
def fn34(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "snapshots")
    items = F.when(F.expr("try_parse_json(data_json) is not null"), F.coalesce(F.json_array_length(F.get_json_object("data_json", "$.quality.findings")), F.lit(0))).otherwise(0)
    return raw.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("deliveries"), F.sum(items).cast("long").alias("items"))


_SPLIT = """old AS (SELECT file_id, h FROM (SELECT file_id, min_by(content_hash, modified_time_ns) AS h FROM files GROUP BY 1) WHERE file_id IN (SELECT file_id FROM parse_results)),
new AS (SELECT file_id, content_hash AS h FROM f WHERE line_count > 0)"""


@register("set02_scan_states", with_views("f", f"""
WITH {_SPLIT} SELECT CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS files FROM old o FULL JOIN new n USING (file_id) GROUP BY ALL"""))
def set02(spark: SparkSession, d: str) -> DataFrame:
    return scan_changes(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def scan_changes(spark: SparkSession, d: str) -> DataFrame:
    """The oldest state of every file that was parsed before, against the newest state of every file with lines."""
    raw = read_table(spark, d, "files")
    before = read_table(spark, d, "parse_results").select("file_id").distinct()
    old = raw.groupBy("file_id").agg(F.min_by("content_hash", "modified_time_ns").alias("content_hash")).join(before, "file_id", "left_semi")
    return I.classify_changes(old, T.files(spark, d).where("line_count > 0").select("file_id", "content_hash"), ["file_id"])


@register("inc01_incremental", with_views("f c s", f"""
WITH {_SPLIT}, st AS (SELECT file_id, CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new n USING (file_id))
SELECT symbol_id, 'old' AS origin FROM s WHERE file_id NOT IN (SELECT file_id FROM st WHERE state IN ('deleted', 'changed')) UNION ALL SELECT symbol_id, 'new' FROM s WHERE file_id IN (SELECT file_id FROM st WHERE state IN ('added', 'changed'))"""))
def inc01(spark: SparkSession, d: str) -> DataFrame:
    symbols = T.symbols(spark, d).select("symbol_id", "file_id")
    rewritten = I.rewrite(symbols.withColumn("origin", F.lit("old")), symbols.withColumn("origin", F.lit("new")), scan_changes(spark, d), ["file_id"])
    return rewritten.select("symbol_id", "origin")


_QA = "qa AS (SELECT doc_id, string_split(text, chr(10))[1] AS question FROM documents WHERE text IS NOT NULL AND lower(trim(source)) IN ('qa', 'issue', 'chat'))"


def questions(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("text is not null and lower(trim(source)) in ('qa', 'issue', 'chat')")
    return rows.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("question"))


_SCORES_SQL = ", ".join(
    f"{{'s': {' + '.join(['0', *[f'CAST(contains(low, {chr(39)}{t}{chr(39)}) AS INTEGER)' for t in plain], *[f'3 * CAST(contains(low, {chr(39)}{t}{chr(39)}) AS INTEGER)' for t in E.STRONG_TERMS.get(intent, [])]])}"
    + (f" + 2 * CAST(regexp_matches(question, '{E.LOCATION}') AS INTEGER)" if intent == "location" else "")
    + f", 'o': {k}, 'i': '{intent}'}}"
    for k, (intent, plain) in enumerate(E.INTENT_TERMS.items())
)
_INTENTS = f"""{_QA}, it AS (SELECT doc_id, question, list_transform(list_sort(list_transform(list_filter([{_SCORES_SQL}], lambda x: x.s > 0), lambda x: {{'a': -x.s, 'b': x.o, 'c': x.i}}))[1:3], lambda x: x.c) AS l FROM (SELECT *, lower(question) AS low FROM qa))"""


@register("qa02_intents", f"WITH {_INTENTS} SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'general' END AS intents FROM it")
def qa02(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("doc_id", F.array_join(E.intents(F.col("question")), ",").alias("intents"))


_EXP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in E.EXPANSIONS.items()) + "}"


@register("qa04_expanded_query", f"WITH {_INTENTS} SELECT doc_id, trim(question || ' ' || array_to_string(list_filter(list_transform(l, lambda x: ({_EXP})[x]), lambda x: x IS NOT NULL), ' ')) AS query FROM it")
def qa04(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("doc_id", E.expanded_query(F.col("question")).alias("query"))


@register("win10_previous_turns", """
WITH t AS (SELECT project_id, doc_id, created_at, CASE WHEN lower(trim(source)) = 'chat' THEN 'user' WHEN lower(trim(source)) = 'review' THEN 'assistant' ELSE 'system' END AS role FROM documents WHERE project_id IS NOT NULL)
SELECT doc_id, last_value(CASE WHEN role = 'user' THEN doc_id END IGNORE NULLS) OVER w AS last_user, last_value(CASE WHEN role = 'assistant' THEN doc_id END IGNORE NULLS) OVER w AS last_assistant
FROM t WINDOW w AS (PARTITION BY project_id ORDER BY created_at NULLS FIRST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win10(spark: SparkSession, d: str) -> DataFrame:
    source = F.lower(F.trim("source"))
    role = F.when(source == "chat", "user").when(source == "review", "assistant").otherwise("system")
    rows = read_table(spark, d, "documents").where("project_id is not null")
    turns = rows.select(F.col("project_id").alias("thread"), F.struct("created_at", "doc_id").alias("position"), role.alias("role"), F.col("doc_id").alias("text"), "doc_id")
    return E.with_previous(turns).select("doc_id", "last_user", "last_assistant")


@register("win04_capped_windows", with_views("c", """
WITH r AS (SELECT project_id, file_id, chunk_id, row_number() OVER (PARTITION BY project_id ORDER BY length(content) DESC, chunk_id) AS rank FROM c WHERE content IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_id ORDER BY rank) AS a FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank) AS place FROM k WHERE a <= 2)
SELECT project_id, chunk_id, CAST(place AS BIGINT) AS place FROM z WHERE place <= 8"""))
def win04(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.length("content").desc(), "chunk_id")
    ranked = T.chunks(spark, d).where("content is not null").select(F.col("project_id").alias("question"), "project_id", "file_id", "chunk_id", F.row_number().over(order).alias("rank"))
    return E.capped(ranked).select("project_id", "chunk_id", F.col("place").cast("long").alias("place"))


@register("qa12_window_selection")
def qa12(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.length("content").desc(), "chunk_id")
    rows = T.chunks(spark, d).where("content is not null and start_line is not null and end_line is not null")
    ranked = rows.select(F.col("project_id").alias("question"), "file_id", "start_line", "end_line", F.col("content").alias("snippet"), F.row_number().over(order).alias("rank"))
    return E.select_windows(ranked)


@register("qa14_confidence", with_views("c fs", """
WITH t AS (SELECT c.project_id AS question, CASE WHEN c.kind = 'function' THEN 'symbol_exact' ELSE 'lexical' END AS source, c.file_id, fs.scope, length(content) / 2000.0 AS semantic FROM c JOIN fs USING (file_id) WHERE content IS NOT NULL)
SELECT question, CASE WHEN bool_or(source = 'symbol_exact') OR (count(DISTINCT CASE WHEN scope = 'production' THEN file_id END) >= 2 AND max(semantic) >= 0.55) THEN 'high' ELSE 'medium' END AS confidence FROM t GROUP BY question"""))
def qa14(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d).select("file_id", S.code_scope(F.col("path")).alias("scope"))
    rows = T.chunks(spark, d).where("content is not null").join(files, "file_id")
    cited = rows.select(F.col("project_id").alias("question"), F.when(F.col("kind") == "function", "symbol_exact").otherwise("lexical").alias("source"), "file_id", "scope", (F.length("content") / 2000.0).alias("semantic"))
    return E.evidence_confidence(cited)


@register("cal07_source_lines", with_views("c", r"""
WITH l AS (SELECT file_id, start_line + n - 1 AS line, x FROM c, unnest(string_split(replace(content, chr(13), ''), chr(10))) WITH ORDINALITY AS t(x, n) WHERE content IS NOT NULL AND start_line IS NOT NULL)
SELECT file_id, count(DISTINCT line) AS lines, count(DISTINCT CASE WHEN k > 1 THEN line END) AS conflicts FROM (SELECT *, count(DISTINCT x) OVER (PARTITION BY file_id, line) AS k FROM l) GROUP BY file_id"""))
def cal07(spark: SparkSession, d: str) -> DataFrame:
    lines = T.chunks(spark, d).where("content is not null and start_line is not null").select("file_id", "start_line", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("n", "x"))
    per = lines.groupBy("file_id", (F.col("start_line") + F.col("n")).alias("line")).agg(F.count_distinct("x").alias("k"))
    return per.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("k") > 1).alias("conflicts"))


@register("cal08_unique_symbols", with_views("c s", "SELECT file_id, qualified_name, min(symbol_id) AS symbol_id FROM s GROUP BY file_id, qualified_name HAVING count(*) = 1"))
def cal08(spark: SparkSession, d: str) -> DataFrame:
    rows = T.symbols(spark, d).groupBy("file_id", "qualified_name").agg(F.min("symbol_id").alias("symbol_id"), F.count(F.lit(1)).alias("n"))
    return rows.where("n = 1").drop("n")


@register("rpt01_insights", with_views("f fs p", """
SELECT f.project_id, count(*) AS files, count_if(fs.scope = 'test') AS test_files, max_by(f.path, struct_pack(a := f.line_count, b := f.path)) AS largest_file, round(100.0 * coalesce(count_if(p.has_syntax_errors), 0) / greatest(1, count(p.file_id)), 1) AS broken_percent
FROM f JOIN fs USING (file_id) LEFT JOIN p USING (file_id) GROUP BY f.project_id"""))
def rpt01(spark: SparkSession, d: str) -> DataFrame:
    rows = T.files(spark, d).join(T.parses(spark, d).select("file_id", "has_syntax_errors", F.lit(1).alias("parsed")), "file_id", "left")
    broken = F.coalesce(F.count_if("has_syntax_errors"), F.lit(0)) * 100.0 / F.greatest(F.lit(1), F.count("parsed"))
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(S.code_scope(F.col("path")) == "test").alias("test_files"), F.max_by("path", F.struct("line_count", "path")).alias("largest_file"), F.round(broken, 1).alias("broken_percent")
    )


@register("agg18_retrieval_metrics", with_views("c", """
WITH r AS (SELECT project_id, chunk_id, kind, row_number() OVER (PARTITION BY project_id ORDER BY length(content) DESC, chunk_id) AS rank FROM c WHERE content IS NOT NULL),
q AS (SELECT project_id, count_if(kind = 'class') AS wanted, count_if(kind = 'class' AND rank <= 5) AS found, min(CASE WHEN kind = 'class' THEN rank END) AS first FROM r GROUP BY project_id)
SELECT count(*) AS cases, round(avg(found / wanted), 4) AS recall_at_5, round(avg(1.0 / first), 4) AS mrr FROM q WHERE wanted > 0"""))
def agg18(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("project_id").orderBy(F.length("content").desc(), "chunk_id")
    ranked = T.chunks(spark, d).where("content is not null").select("project_id", "kind", F.row_number().over(order).alias("rank"))
    hit = F.col("kind") == "class"
    per = ranked.groupBy("project_id").agg(F.count_if(hit).alias("wanted"), F.count_if(hit & (F.col("rank") <= 5)).alias("found"), F.min(F.when(hit, F.col("rank"))).alias("first")).where("wanted > 0")
    return per.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("found") / F.col("wanted")), 4).alias("recall_at_5"), F.round(F.avg(F.lit(1.0) / F.col("first")), 4).alias("mrr"))


@register("str01_event_windows", """
SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def str01(spark: SparkSession, d: str) -> DataFrame:
    from repolith.streaming.events import windowed

    rows = windowed(read_table(spark, d, "events"), watermark=None)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@register("tpc01_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpc01(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


@register("tpc03_segment_orders", """
SELECT n_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def tpc03(spark: SparkSession, d: str) -> DataFrame:
    t = {n: read_table(spark, d, n) for n in ("customer", "orders", "lineitem", "nation")}
    lines = t["lineitem"].groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))  # before the joins
    rows = t["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("v"), 2).alias("revenue"))
