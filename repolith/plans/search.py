"""Queries over texts and vectors: tokens, windows, BM25, snippets, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions import scalars as S
from repolith.operators import search as R
from repolith.plans.registry import register
from repolith.plans.views import with_views
from repolith.runtime import read_table
from repolith.sources import tables as T

_QUERY = "load shuttle index session"

_TOKENS = r"""flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|\d+|[一-鿿]+'), lambda x:
  CASE WHEN regexp_matches(x, '^[一-鿿]') THEN list_concat([lower(x)], CASE WHEN length(x) > 1 THEN list_transform(range(1, length(substr(x, 1, 512))), lambda i: substr(substr(x, 1, 512), i, 2)) ELSE [] END)
  ELSE list_concat([lower(x)], list_filter(list_transform(string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_'), lambda y: lower(y)), lambda y: y <> '' AND y <> lower(x))) END))"""
_CONCEPT_SQL = ",\n  ".join(
    f"CASE WHEN regexp_matches(head, '{p}') THEN '{label}' END" for p, label in R.CONCEPTS
)
_META = f"""meta AS (SELECT *, concat_ws(chr(10), 'path ' || path, 'symbol ' || coalesce(symbol_name, '') || ' ' || coalesce(symbol_name, ''), 'kind ' || kind, CASE WHEN scope = 'test' THEN '{R.TEST_LABEL}' END,
  {_CONCEPT_SQL}) AS metadata FROM (
  SELECT c.*, fs.path, fs.scope, concat_ws(chr(10), fs.path, coalesce(c.symbol_name, ''), substr(c.content, 1, 6000)) AS head FROM c JOIN fs USING (file_id) WHERE c.content IS NOT NULL))"""
_SIZED = f"sized AS (SELECT project_id, chunk_id, path, scope, symbol_name, {_TOKENS.format(text='metadata || chr(10) || content')} AS tokens FROM meta)"


def passages(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").join(T.files(spark, d).select("file_id", "path"), "file_id")
    meta = R.passage_metadata(F.col("path"), F.col("symbol_name"), F.col("kind"), F.col("content"))
    return rows.select("project_id", "chunk_id", "path", "symbol_name", "content", F.concat(meta, F.lit("\n"), F.col("content")).alias("text"))


_INDEXES: dict[tuple[str, str], str] = {}  # (application, input) -> folder of the index


def index_of(spark: SparkSession, d: str) -> str:
    """The index of the passages of ``d``, built by the first question of an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = R.build_index(passages(spark, d))
    return _INDEXES[key]


@register("fn01_tokens", with_views("c", f"""
WITH t AS (SELECT chunk_id, {_TOKENS.format(text='content')} AS t FROM c WHERE content IS NOT NULL)
SELECT chunk_id, CAST(len(t) AS BIGINT) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM t"""))
def fn01(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", S.code_tokens(F.col("content")).alias("t"))
    return rows.select("chunk_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@register("fn17_passage_metadata", with_views("c fs", f"WITH {_META} SELECT chunk_id, md5(metadata) AS digest, CAST(length(metadata) AS BIGINT) AS size FROM meta"))
def fn17(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").join(T.files(spark, d).select("file_id", "path"), "file_id")
    meta = rows.select("chunk_id", R.passage_metadata(F.col("path"), F.col("symbol_name"), F.col("kind"), F.col("content")).alias("m"))
    return meta.select("chunk_id", F.md5("m").alias("digest"), F.length("m").cast("long").alias("size"))


@register("txt02_line_windows", r"""
WITH t AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM t),
w AS (SELECT doc_id, l, unnest(range(0, greatest(1, CAST(ceil((len(l) - 80) / 68.0) AS INTEGER) + 1))) AS k FROM u WHERE len(l) > 0),
x AS (SELECT doc_id, k * 68 + 1 AS start_line, least(k * 68 + 80, len(l)) AS end_line, substr(array_to_string(l[k * 68 + 1 : k * 68 + 80], chr(10)), 1, 16000) AS content FROM w)
SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, md5(content) AS digest FROM x WHERE trim(translate(content, chr(10) || chr(9), '')) <> ''""")
def txt02(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.line_windows(docs).select(F.col("id").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("digest"))


@register("txt04_postings", with_views("c fs", f"""
WITH {_META}, {_SIZED} SELECT term, CAST(count(*) AS BIGINT) AS occurrences, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, unnest(tokens) AS term FROM sized) GROUP BY term"""))
def txt04(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{index_of(spark, d)}/postings")
    return p.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("chunks"))


@register("agg12_corpus_statistics", with_views("c fs", f"""
WITH {_META}, {_SIZED} SELECT project_id, count(*) AS documents, round(avg(len(tokens)), 4) AS avg_length FROM sized GROUP BY project_id"""))
def agg12(spark: SparkSession, d: str) -> DataFrame:
    sized = spark.read.parquet(f"{index_of(spark, d)}/passages")
    return sized.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("doc_len"), 4).alias("avg_length"))


_BM25 = f"""{_META}, {_SIZED}, q AS (SELECT DISTINCT unnest({_TOKENS.format(text=f"'{_QUERY}'")}) AS term), corpus AS (SELECT project_id, count(*) AS n, avg(len(tokens)) AS avgl FROM sized GROUP BY 1),
tf AS (SELECT project_id, chunk_id, path, scope, symbol_name, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(tokens) AS term FROM sized) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT project_id, term, count(*) AS df FROM tf GROUP BY ALL),
b AS (SELECT tf.project_id, chunk_id, path, scope, symbol_name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgl, 1.0)))) AS bm25
  FROM tf JOIN df USING (project_id, term) JOIN corpus USING (project_id) GROUP BY ALL),
r AS (SELECT *, bm25 * CASE scope WHEN 'generated' THEN 0.15 WHEN 'test' THEN 0.55 ELSE 1.08 END AS boosted, (SELECT bool_or(contains(lower(coalesce(symbol_name, '')), term)) FROM q) AS named FROM b)"""


@register("txt05_bm25_search", with_views("c fs", f"""
WITH {_BM25} SELECT project_id, chunk_id, round(CASE WHEN named THEN boosted * 1.15 + 0.35 ELSE boosted END, 4) AS score FROM r"""))
def txt05(spark: SparkSession, d: str) -> DataFrame:
    return R.search(index_of(spark, d), _QUERY, spark=spark).select("project_id", "chunk_id", "score")


@register("srt06_search_page", with_views("c fs", f"""
WITH {_BM25}, k AS (SELECT chunk_id, path, round(CASE WHEN named THEN boosted * 1.15 + 0.35 ELSE boosted END, 4) AS score FROM r)
SELECT chunk_id, score FROM k ORDER BY score DESC, path, chunk_id LIMIT 10"""))
def srt06(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search(index_of(spark, d), _QUERY, spark=spark)
    return hits.orderBy(F.col("score").desc(), "path", "chunk_id").limit(10).select("chunk_id", "score")


@register("fn16_snippet_line", with_views("c", f"""
WITH q AS (SELECT {_TOKENS.format(text=f"'{_QUERY}'")} AS terms),
l AS (SELECT chunk_id, n, x FROM c, unnest(string_split(replace(content, chr(13), ''), chr(10))) WITH ORDINALITY AS t(x, n) WHERE content IS NOT NULL),
h AS (SELECT chunk_id, min(n) AS n FROM l, q WHERE list_has_any({_TOKENS.format(text='x')}, terms) GROUP BY 1)
SELECT c.chunk_id, CAST(coalesce(h.n, 1) AS BIGINT) AS line FROM c LEFT JOIN h USING (chunk_id) WHERE content IS NOT NULL"""))
def fn16(spark: SparkSession, d: str) -> DataFrame:
    terms = S.code_tokens(F.lit(_QUERY))
    return T.chunks(spark, d).where("content is not null").select("chunk_id", (R.snippet_line(F.col("content"), terms) + 1).cast("long").alias("line"))


@register("set07_jaccard", with_views("c", f"""
WITH t AS (SELECT chunk_id, file_id, start_line, list_distinct({_TOKENS.format(text='content')}) AS t, row_number() OVER (PARTITION BY file_id ORDER BY start_line NULLS FIRST, chunk_id) AS n FROM c WHERE content IS NOT NULL)
SELECT a.chunk_id, round(len(list_intersect(a.t, b.t)) / greatest(1, len(list_distinct(list_concat(a.t, b.t)))), 4) AS similarity FROM t a JOIN t b ON a.file_id = b.file_id AND b.n = a.n + 1"""))
def set07(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("file_id").orderBy("start_line", "chunk_id")
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", "file_id", "start_line", F.array_distinct(S.code_tokens(F.col("content"))).alias("t"))
    pairs = rows.withColumn("u", F.lead("t").over(line)).where("u is not null")
    return pairs.select("chunk_id", F.round(R.jaccard(F.col("t"), F.col("u")), 4).alias("similarity"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
_COS = f"""vu AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), vq AS (SELECT v FROM vu WHERE vec_id = 0),
k AS (SELECT vec_id, label, list_dot_product(vu.v, vq.v) AS cosine FROM vu, vq)"""


@register("fn09_unit_vectors", f"SELECT vec_id, round(list_sum(list_transform({_UNIT}, lambda x: x * x)), 6) AS norm, round(({_UNIT})[1], 6) AS first FROM embeddings")
def fn09(spark: SparkSession, d: str) -> DataFrame:
    rows = T.vectors(spark, d).select("vec_id", S.unit_vector(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(S.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.try_element_at("u", F.lit(1)), 6).alias("first"))


@register("fn10_cosine", f"WITH {_COS} SELECT vec_id, round(cosine, 5) AS cosine FROM k")
def fn10(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    return R.cosine_hits(v, v.where("vec_id = 0"), least=-2.0).select("vec_id", F.round("cosine", 5).alias("cosine"))


@register("vec02_semantic_search", f"""
WITH {_COS}, p AS (SELECT * FROM k WHERE cosine >= 0.22 ORDER BY cosine DESC, vec_id LIMIT 48)
SELECT vec_id, round(cosine * CASE label % 3 WHEN 0 THEN 1.05 WHEN 1 THEN 0.58 ELSE 0.15 END * 30, 3) AS score FROM p ORDER BY cosine * CASE label % 3 WHEN 0 THEN 1.05 WHEN 1 THEN 0.58 ELSE 0.15 END DESC, vec_id LIMIT 16""")
def vec02(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    top = R.cosine_hits(v, v.where("vec_id = 0")).orderBy(F.col("cosine").desc(), "vec_id").limit(48)
    factor = F.when(F.col("label") % 3 == 0, 1.05).when(F.col("label") % 3 == 1, 0.58).otherwise(0.15)
    weighed = top.withColumn("w", F.col("cosine") * factor)
    return weighed.orderBy(F.col("w").desc(), "vec_id").limit(16).select("vec_id", F.round(F.col("w") * 30, 3).alias("score"))


@register("vec03_dense_rerank", f"""
WITH {_COS}, c AS (SELECT vec_id, cosine, row_number() OVER (ORDER BY vec_id) AS rn FROM k)
SELECT vec_id, round(CASE WHEN rn <= 36 THEN greatest(0.0, cosine) * 22 ELSE 0.0 END + 100.0 / (rn + 9), 3) AS score FROM c WHERE rn <= 60""")
def vec03(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    head = R.cosine_hits(v, v.where("vec_id = 0"), least=-2.0).orderBy("vec_id").limit(60)
    ranked = head.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("vec_id")))  # 60 candidates
    gain = F.when(F.col("rn") <= 36, F.greatest(F.lit(0.0), F.col("cosine")) * 22).otherwise(0.0)
    return ranked.select("vec_id", F.round(gain + F.lit(100.0) / (F.col("rn") + 9), 3).alias("score"))


@register("vec06_rerank_all_queries")
def vec06(spark: SparkSession, d: str) -> DataFrame:
    """The re-ranking of ``vec03`` for every query, over the candidates of its search."""
    gain = F.when(F.col("rank") <= 36, F.greatest(F.lit(0.0), F.col("cosine")) * 22).otherwise(0.0)
    return R.nearest(T.vectors(spark, d)).select("query_id", "vec_id", F.round(gain + F.lit(100.0) / (F.col("rank") + 9), 3).alias("score"))


@register("vec05_passage_signature", with_views("c", "SELECT project_id, count(*) AS passages, max(chunk_id) AS max_id, CAST(sum(length(substr(content, 1, 2400))) AS BIGINT) AS chars FROM c WHERE content IS NOT NULL GROUP BY project_id"))
def vec05(spark: SparkSession, d: str) -> DataFrame:
    rows = T.chunks(spark, d).where("content is not null").groupBy("project_id")
    return rows.agg(F.count(F.lit(1)).alias("passages"), F.max("chunk_id").alias("max_id"), F.sum(F.length(F.substring("content", 1, 2400))).alias("chars"))


@register("vec04_coverage_selection", with_views("c fs", """
WITH t AS (SELECT c.chunk_id, c.project_id, fs.scope, fs.path, c.kind, c.start_line, row_number() OVER (PARTITION BY c.file_id ORDER BY c.kind, c.start_line NULLS FIRST, c.chunk_id) AS rn FROM c JOIN fs USING (file_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rn > 1, CASE scope WHEN 'production' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, path, kind, start_line NULLS FIRST, chunk_id) AS place FROM t)
SELECT chunk_id, CAST(place AS BIGINT) AS place FROM r WHERE place <= 100"""))
def vec04(spark: SparkSession, d: str) -> DataFrame:
    files = T.files(spark, d).select("file_id", "path", S.code_scope(F.col("path")).alias("scope"))
    rows = T.chunks(spark, d).join(files, "file_id")
    rn = F.row_number().over(Window.partitionBy("file_id").orderBy("kind", "start_line", "chunk_id"))
    rank = F.when(F.col("scope") == "production", 0).when(F.col("scope") == "test", 1).otherwise(2)
    order = Window.partitionBy("project_id").orderBy(F.col("rn") > 1, rank, "path", "kind", "start_line", "chunk_id")
    return rows.withColumn("rn", rn).withColumn("place", F.row_number().over(order).cast("long")).where("place <= 100").select("chunk_id", "place")


@register("fus01_reciprocal_rank", with_views("c fs", f"""
WITH {_BM25}, {_COS}, k2 AS (SELECT chunk_id, row_number() OVER (ORDER BY round(CASE WHEN named THEN boosted * 1.15 + 0.35 ELSE boosted END, 4) DESC, path, chunk_id) AS rn FROM r),
p AS (SELECT chunk_id AS item, rn FROM k2 WHERE rn <= 64 UNION ALL SELECT vec_id, row_number() OVER (ORDER BY round(cosine, 5) DESC, vec_id) FROM k QUALIFY row_number() OVER (ORDER BY round(cosine, 5) DESC, vec_id) <= 64)
SELECT item, round(sum(1.0 / (60 + rn)), 6) AS fused FROM p GROUP BY item"""))
def fus01(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    lexical = R.search(index_of(spark, d), _QUERY, spark=spark).orderBy(F.col("score").desc(), "path", "chunk_id").limit(64)
    lexical = lexical.select(F.lit("lexical").alias("pool"), F.col("chunk_id").alias("item"), F.struct((-F.col("score")).alias("a"), F.col("path").alias("b"), F.col("chunk_id").alias("c")).alias("position"))
    dense = R.cosine_hits(v, v.where("vec_id = 0"), least=-2.0).withColumn("cosine", F.round("cosine", 5)).orderBy(F.col("cosine").desc(), "vec_id").limit(64)
    dense = dense.select(F.lit("dense").alias("pool"), F.col("vec_id").alias("item"), F.struct((-F.col("cosine")).alias("a"), F.lit("").alias("b"), F.col("vec_id").alias("c")).alias("position"))
    return R.reciprocal_ranks(lexical.unionByName(dense)).select("item", F.round("fused", 6).alias("fused"))


# Where a database entity is named.
_ENTITY = [r"(?i)__tablename__\s*=\s*['\"]([A-Za-z0-9_.-]+)['\"]", r"\b(?:FROM|JOIN|INSERT\s+INTO|UPDATE)\s+[`\"\[]?([A-Za-z_][A-Za-z0-9_.-]*)", r"(?i)\bprisma\.([A-Za-z_][A-Za-z0-9_]*)"]
# Words that are no tables.
_STOP = [
    "a", "an", "and", "as", "by", "data", "database", "for", "from", "in", "into", "of", "on", "or", "select", "table", "that", "the", "this", "to",
    "update", "where", "with",
]
_ENTITY_SQL = "list_concat(" + ", ".join("regexp_extract_all(content, '" + p.replace("'", "''") + "', 1)" for p in _ENTITY) + ")"


@register("fn19_database_entities", with_views("c", f"""
WITH t AS (SELECT chunk_id, unnest({_ENTITY_SQL}) AS e FROM c WHERE content IS NOT NULL)
SELECT lower(e) AS entity, count(DISTINCT chunk_id) AS chunks FROM t WHERE lower(e) NOT IN ({", ".join(f"'{w}'" for w in _STOP)}) GROUP BY 1"""))
def fn19(spark: SparkSession, d: str) -> DataFrame:
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in _ENTITY])
    rows = T.chunks(spark, d).where("content is not null").select("chunk_id", F.explode(found).alias("e")).where(~F.lower("e").isin(_STOP))
    return rows.groupBy(F.lower("e").alias("entity")).agg(F.count_distinct("chunk_id").alias("chunks"))


@register("fn18_startup_commands", r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, unnest(regexp_extract_all(x, '`((?:npm|pnpm|yarn|uvicorn|flask|python3?|make|bash|uv|pip) [^`]+)`', 1)) AS command FROM l)
SELECT command, count(*) AS uses FROM k GROUP BY command""")
def fn18(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("x"))
    found = lines.select(F.explode(F.regexp_extract_all("x", F.lit("`((?:npm|pnpm|yarn|uvicorn|flask|python3?|make|bash|uv|pip) [^`]+)`"), F.lit(1))).alias("command"))
    return found.groupBy("command").agg(F.count(F.lit(1)).alias("uses"))


@register("fn22_history_hints", r"""
WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(substr(text, 1, 6000), '`([^`\n]{2,160})`', 1), lambda x: x <> '') AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(list_distinct(h)), '|') AS hints, CAST(len(list_distinct(h)) AS BIGINT) AS n FROM k WHERE len(h) > 0""")
def fn22(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.substring("text", 1, 6000), F.lit("`([^`\n]{2,160})`"), F.lit(1)))
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", found.alias("h")).where(F.size("h") > 0)
    return rows.select("doc_id", F.array_join(F.array_sort("h"), "|").alias("hints"), F.size("h").cast("long").alias("n"))


# Words too general to be a target of a question.
_GENERIC = [
    "the", "this", "that", "where", "what", "which", "project", "function", "method", "class", "file", "code", "table", "database", "start", "run",
    "change", "impact", "repository", "repo", "how", "does", "are", "can", "could", "would", "should", "for", "and", "with", "from", "into", "about",
    "current", "please", "tell", "show", "tests", "test", "cover", "covers", "have", "has", "its", "http", "https", "api", "sql", "json", "yaml",
    "xml", "html", "css", "rest", "tcp", "udp", "get", "post", "put", "patch", "delete",
]


@register("fn20_explicit_targets", rf"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./:-]*'), lambda x: trim(regexp_replace(x, ':\d+(-\d+)?$', ''), './:-')) AS k FROM documents WHERE text IS NOT NULL AND lower(trim(source)) = 'chat'),
u AS (SELECT doc_id, list_filter(k, lambda x: (contains(x, '_') OR contains(x, '/') OR contains(x, '.') OR regexp_matches(x, '[a-z][A-Z]') OR (length(x) >= 3 AND regexp_matches(x, '^[^a-z]*[A-Z][^a-z]*$'))) AND NOT list_contains([{", ".join(f"'{w}'" for w in _GENERIC)}], lower(x))) AS k FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(k, lambda x: lower(x)))), '|') AS targets FROM u WHERE len(k) > 0""")
def fn20(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_./:-]*)"), F.lit(1))
    bare = F.transform(raw, lambda x: F.btrim(F.regexp_replace(x, r":\d+(-\d+)?$", ""), F.lit("./:-")))
    shaped = lambda x: (x.contains("_") | x.contains("/") | x.contains(".") | x.rlike("[a-z][A-Z]") | ((F.length(x) >= 3) & x.rlike("^[^a-z]*[A-Z][^a-z]*$"))) & ~F.lower(x).isin(_GENERIC)
    rows = read_table(spark, d, "documents").where("text is not null and lower(trim(source)) = 'chat'").select("doc_id", F.filter(bare, shaped).alias("k")).where(F.size("k") > 0)
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("k", F.lower))), "|").alias("targets"))


@register("fn15_edit_similarity")
def fn15(spark: SparkSession, d: str) -> DataFrame:
    from repolith.functions.similarity import gestalt_ratio

    names = T.symbols(spark, d).select("name").distinct()
    return names.select("name", F.round(gestalt_ratio(F.col("name"), F.lit("load_queue")), 4).alias("ratio")).where("ratio >= 0.72")
