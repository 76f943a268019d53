"""Text retrieval: chunk windows, postings, BM25, snippets, vectors and rank fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.functions.scalars import bm25, code_scope, code_tokens, dot, unit_vector
from repolith.runtime import TASK_BYTES, cpu_partitions, input_bytes, shared_folder

CHUNK_LINES, CHUNK_STEP, CONTAINER_LINES, CHUNK_CHARS = 80, 68, 40, 16_000
TEST_WORDS = ["test", "tests", "spec", "coverage", "测试", "用例", "覆盖率"]
# What a passage is also found under, by what its text contains.
CONCEPTS = [
    (r"(?i)(@\w*router\.|@app\.(get|post|put|patch|delete)|\b(route|router|endpoint|controller)\b)", "api route endpoint controller handler 接口 路由 端点"),
    (r"(?i)(__tablename__|\bselect\b.+\bfrom\b|\binsert\s+into\b|\bupdate\b.+\bset\b|\bdelete\s+from\b|sqlalchemy|prisma|repository|\bdao\b)", "database table model query persistence repository 数据库 数据表 持久化"),
    (r"(?i)(os\.environ|os\.getenv|process\.env|import\.meta\.env|base_settings|dotenv|environment)", "config settings environment env configuration 配置 环境变量"),
    (r"(?i)(\b(raise|throw|except|catch)\b|exception|error_handler|retry)", "error exception failure handling retry 异常 错误 失败 重试"),
    (r"(?i)(\b(login|signin|authenticate|authorize|jwt|token|session|password)\b)", "authentication authorization login session user 登录 认证 鉴权 会话"),
    (r"(?i)(\b(redis|cache|memoize|lru_cache)\b)", "cache redis caching 缓存"),
]
TEST_LABEL = "test tests spec coverage 测试 用例 覆盖率"


def line_windows(documents: DataFrame, *, lines: int = CHUNK_LINES, step: int = CHUNK_STEP, chars: int = CHUNK_CHARS) -> DataFrame:
    """documents (id, content) -> id, start_line, end_line, content: overlapping windows, blank ones dropped."""
    split = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")
    rows = documents.withColumn("lines", F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)).where(F.size("lines") > 0)
    last = F.greatest(F.lit(1), F.ceil((F.size("lines") - lines) / step).cast("int") + 1)
    spread = rows.withColumn("k", F.explode(F.sequence(F.lit(0), last - 1)))
    begin = F.col("k") * step + 1
    text = F.substring(F.array_join(F.slice("lines", begin, F.lit(lines)), "\n"), 1, chars)
    return spread.select("id", begin.alias("start_line"), F.least(begin + lines - 1, F.size("lines")).alias("end_line"), text.alias("content")).where(F.trim(F.translate("content", "\n\t", "")) != "")


def passage_metadata(path: Column, symbol: Column, kind: Column, content: Column) -> Column:
    name = F.coalesce(symbol, F.lit(""))
    head = F.concat_ws("\n", path, name, F.substring(content, 1, 6000))
    labels = [F.concat(F.lit("path "), path), F.concat(F.lit("symbol "), name, F.lit(" "), name), F.concat(F.lit("kind "), kind), F.when(code_scope(path) == "test", TEST_LABEL)]
    return F.concat_ws("\n", *labels, *[F.when(head.rlike(pattern), label) for pattern, label in CONCEPTS])


def postings(passages: DataFrame) -> DataFrame:
    """passages (project_id, chunk_id, text) -> project_id, chunk_id, term, tf, doc_len.

    Terms are counted inside the row (one pass over its own sorted tokens) so
    that only distinct terms leave it; no shuffle is needed.
    """
    tokens = passages.select("project_id", "chunk_id", F.array_sort(code_tokens(F.col("text"))).alias("t"))
    flat = tokens.select("project_id", "chunk_id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return flat.groupBy("project_id", "chunk_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


#: Terms whose hash falls together share a folder of the index.
INDEX_BUCKETS = 64


def build_index(passages: DataFrame) -> str:
    """Writes the postings and lengths of passages (project_id, chunk_id, path, symbol_name, text) once; the folder they are in.

    Postings stand in ``INDEX_BUCKETS`` folders by term hash and sorted by term, so that a
    question reads the folders of its terms and there, by the statistics of the
    files, little more than their rows. A term that stands in a third of all
    passages is dealt out over the files of its folder by its chunks.
    """
    spark = passages.sparkSession
    tokens = passages.select("project_id", "chunk_id", "path", "symbol_name", F.array_sort(code_tokens(F.col("text"))).alias("t"))
    # Equal terms of a row are counted inside the row: its sorted tokens end where the next one differs.
    last = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == F.size("t")) | (F.get("t", i - 1) != F.get("t", i)))
    ended = tokens.withColumn("ends", F.when(F.size("t") > 0, last).otherwise(F.array().cast("array<int>")))
    counted = F.transform("ends", lambda e, k: F.struct(F.get("t", e - 1).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("tf")))
    folder = f"{shared_folder(spark)}/index/{uuid.uuid4().hex}"
    sized = ended.select("project_id", "chunk_id", "path", "symbol_name", F.size("t").alias("doc_len"), counted.alias("terms"))
    sized.write.parquet(f"{folder}/passages")
    flat = spark.read.parquet(f"{folder}/passages").select("project_id", "chunk_id", "path", "symbol_name", "doc_len", F.explode("terms").alias("x")).select("project_id", "chunk_id", "path", "symbol_name", "doc_len", "x.term", "x.tf")
    bucket = F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int")
    placed = flat.withColumn("bucket", bucket)
    placed = placed.repartition(cpu_partitions(spark, input_bytes(placed)), "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, input_bytes(placed) // TASK_BYTES))))
    placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    return folder


def search(index: str | DataFrame, query: str, *, spark: SparkSession | None = None, test_focused: bool | None = None) -> DataFrame:
    """BM25 over an index (a folder of ``build_index``, or passages that are indexed first): every hit with its boosted score.

    Corpus statistics are per project and over all of its passages. Only postings
    of the query's terms are read; documents without any of them score 0 and do
    not appear.
    """
    if isinstance(index, DataFrame):
        spark, index = index.sparkSession, build_index(index)
    terms = [r.t for r in spark.range(1).select(F.explode(F.array_distinct(code_tokens(F.lit(query)))).alias("t")).collect()]  # of one query
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    buckets = [r.b for r in spark.range(1).select(F.explode(wanted).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(INDEX_BUCKETS)).cast("int").alias("b")).distinct().collect()]
    corpus = spark.read.parquet(f"{index}/passages").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    postings_schema = "project_id bigint, chunk_id bigint, path string, symbol_name string, doc_len int, term string, tf int, bucket int"
    counted = spark.read.schema(postings_schema).parquet(f"{index}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")
    frequency = counted.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = counted.join(frequency, ["project_id", "term"]).join(corpus, "project_id")
    score = bm25(F.col("tf"), F.col("doc_len"), F.col("avg_len"), F.col("n_docs"), F.col("df"))
    total = scored.groupBy("project_id", "chunk_id", "path", "symbol_name").agg(F.sum(score).alias("bm25"))
    focus = bool(set(terms) & set(TEST_WORDS)) if test_focused is None else test_focused
    scope = code_scope(F.col("path"))
    factor = F.when(scope == "generated", 0.15).when(scope == "test", 1.15 if focus else 0.55).otherwise(1.08)
    symbol = F.lower(F.coalesce("symbol_name", F.lit("")))
    named = F.exists(wanted, lambda t: F.contains(symbol, t))
    boosted = F.col("bm25") * factor
    return total.withColumn("score", F.round(F.when(named, boosted * 1.15 + 0.35).otherwise(boosted), 4))


def snippet_line(content: Column, terms: Column) -> Column:
    """0-based index of the first line with a query token; 0 if no line has one."""
    lines = F.split(content, r"\r?\n")
    hit = F.filter(F.transform(lines, lambda x, i: F.when(F.arrays_overlap(code_tokens(x), terms), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0))


def cosine_hits(vectors: DataFrame, query: DataFrame, *, least: float = 0.22) -> DataFrame:
    """vectors (id, embedding) against one query vector: id, cosine at or above ``least``."""
    unit = vectors.select(*[c for c in vectors.columns if c != "embedding"], unit_vector(F.col("embedding")).alias("u"))
    one = query.select(unit_vector(F.col("embedding")).alias("q")).limit(1)
    return unit.crossJoin(F.broadcast(one)).withColumn("cosine", dot(F.col("u"), F.col("q"))).where(F.col("cosine") >= least).drop("u", "q")  # one query row


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 60) -> DataFrame:
    """query_id, vec_id, cosine, rank: the k nearest of all vectors to every vector whose id is divisible by ``every``."""
    unit = vectors.where("embedding is not null").select("vec_id", unit_vector(F.col("embedding")).alias("u"))
    queries = unit.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    pairs = queries.crossJoin(unit).select("query_id", "vec_id", dot(F.col("u"), F.col("q")).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_ranks(pools: DataFrame, *, constant: int = 60) -> DataFrame:
    """pools (pool, item, position) -> item, fused; a repeated item counts at its first place in a pool."""
    first = pools.groupBy("pool", "item").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("position", "item"))
    return first.withColumn("rank", rank).groupBy("item").agg(F.sum(F.lit(1.0) / (F.col("rank") + constant)).alias("fused"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
