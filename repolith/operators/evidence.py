"""Evidence for questions: intents, query expansion, windows, ranking and selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The terms that speak for an intent (weight 1).
INTENT_TERMS = {
    "startup": ["启动", "运行", "部署", "start", "run", "serve", "install"],
    "auth": ["登录", "鉴权", "认证", "权限", "login", "signin", "auth", "token", "session"],
    "database": ["哪张表", "数据库", "数据表", "持久化", "table", "database", "sql", "model"],
    "impact": ["影响", "修改", "调用者", "依赖", "impact", "change", "caller", "reference"],
    "api": ["接口", "路由", "端点", "api", "route", "endpoint", "controller"],
    "config": ["配置", "环境变量", "密钥", "端口", "config", "environment", "env", "setting", "port"],
    "test": ["测试", "用例", "覆盖率", "test", "spec", "coverage"],
    "error": ["报错", "异常", "错误", "失败", "error", "exception", "failed", "failure"],
    "location": [],
}
# The terms that speak strongly for an intent (weight 3).
STRONG_TERMS = {
    "startup": ["如何启动", "怎么启动", "怎样运行", "how to start", "how to run"],
    "auth": ["登录功能", "鉴权流程", "认证流程", "login flow", "authentication"],
    "database": ["哪张表", "数据表", "表名", "database table", "which table", "sql"],
    "impact": ["会影响", "影响什么", "修改", "调用者", "impact", "caller"],
    "api": ["接口在哪里", "路由在哪里", "which endpoint", "api route"],
    "config": ["如何配置", "环境变量", "配置文件", "configuration file"],
    "test": ["相关测试", "测试用例", "test case", "test coverage"],
    "error": ["为什么报错", "异常在哪里", "错误处理", "why does it fail"],
}
# How a question asks for a place, and the words a query is widened by.
LOCATION = r"(?i)(在哪里|在哪个文件|位置|定位|where\s+(is|are|does)|which\s+file)"
EXPANSIONS = {
    "startup": "main startup start run serve dev scripts npm pnpm yarn uvicorn docker compose __main__",
    "auth": "login signin sign_in authentication authorize auth token session jwt password user route controller",
    "database": "__tablename__ table database sqlalchemy prisma repository model select insert update delete query",
    "impact": "function method class import dependency reference usage caller test spec",
    "location": "definition declaration function method class route controller service",
    "api": "api route routes router endpoint endpoints controller handler request response restful",
    "config": "config configuration settings environment env port secret yaml toml json",
    "test": "test tests spec fixture mock assertion coverage integration e2e",
    "error": "error exception raise catch except failure failed retry log handling",
}
PER_FILE, IN_TOTAL, MERGED_LINES, SIMILAR = 2, 8, 48, 0.82


def intent_scores(question: Column) -> Column:
    """Array of (score, order, intent) with a positive score, best first."""
    low = F.lower(question)
    rows = []
    for order, (intent, plain) in enumerate(INTENT_TERMS.items()):
        score = F.lit(0)
        for term in plain:
            score = score + low.contains(term).cast("int")
        for term in STRONG_TERMS.get(intent, []):
            score = score + low.contains(term).cast("int") * 3
        if intent == "location":
            score = score + question.rlike(LOCATION).cast("int") * 2
        rows.append(F.struct((-score).alias("negative"), F.lit(order).alias("place"), F.lit(intent).alias("intent")))
    return F.filter(F.array_sort(F.array(*rows)), lambda r: r["negative"] < 0)


def intents(question: Column) -> Column:
    """Up to three intents, ``general`` if none speaks."""
    found = F.transform(F.slice(intent_scores(question), 1, 3), lambda r: r["intent"])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def expanded_query(question: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])
    extra = F.transform(intents(question), lambda i: F.coalesce(F.try_element_at(words, i), F.lit("")))
    return F.trim(F.concat_ws(" ", question, F.array_join(F.filter(extra, lambda x: x != ""), " ")))


def with_previous(turns: DataFrame) -> DataFrame:
    """turns (thread, position, role, text) with the last user and assistant text before each."""
    before = Window.partitionBy("thread").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(before)
    return turns.withColumn("last_user", last("user")).withColumn("last_assistant", last("assistant"))


def capped(ranked: DataFrame, *, per_file: int = PER_FILE, total: int = IN_TOTAL) -> DataFrame:
    """ranked (question, file_id, rank): at most ``per_file`` windows of a file and ``total`` in all, by rank."""
    inside = F.row_number().over(Window.partitionBy("question", "file_id").orderBy("rank"))
    overall = F.row_number().over(Window.partitionBy("question").orderBy("rank"))
    return ranked.withColumn("__f", inside).where(F.col("__f") <= per_file).drop("__f").withColumn("place", overall).where(F.col("place") <= total)


def select_windows(candidates: DataFrame) -> DataFrame:
    """Greedy selection per question (candidates are at most 64 each): question, file_id, start_line, end_line, place.

    In rank order a window is merged into a selected one of its file that it
    overlaps or touches while the two stay within ``MERGED_LINES``, dropped if
    its words are ``SIMILAR`` to those of a selected one, and kept otherwise,
    within the caps. The fold depends on the order, so it runs as a grouped map.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[list] = []
        for row in pdf.sort_values(["rank", "file_id", "start_line"]).itertuples():
            words = set(str(row.snippet or "").lower().split())
            merged = False
            for kept in chosen:
                if kept[0] != row.file_id:
                    continue
                low, high = min(kept[1], row.start_line), max(kept[2], row.end_line)
                if row.start_line <= kept[2] + 1 and kept[1] <= row.end_line + 1 and high - low + 1 <= MERGED_LINES:
                    kept[1], kept[2], kept[3] = low, high, kept[3] | words
                    merged = True
                    break
            if merged or any(len(words & k[3]) / max(1, len(words | k[3])) >= SIMILAR for k in chosen):
                continue
            if sum(k[0] == row.file_id for k in chosen) < PER_FILE and len(chosen) < IN_TOTAL:
                chosen.append([row.file_id, row.start_line, row.end_line, words])
        rows = [(pdf["question"].iloc[0], k[0], k[1], k[2], n + 1) for n, k in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["question", "file_id", "start_line", "end_line", "place"])

    bounded = candidates.withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("rank", "file_id", "start_line"))).where("__n <= 64").drop("__n")
    return bounded.groupBy("question").applyInPandas(fold, "question bigint, file_id bigint, start_line int, end_line int, place int")


def evidence_confidence(citations: DataFrame) -> DataFrame:
    """citations (question, source, file_id, scope, semantic) -> question, confidence."""
    t = citations.groupBy("question").agg(
        F.max(F.col("source") == "symbol_exact").alias("exact"), F.count_distinct(F.when(F.col("scope") == "production", F.col("file_id"))).alias("files"), F.max(F.coalesce("semantic", F.lit(0.0))).alias("peak")
    )
    return t.select("question", F.when(F.col("exact") | ((F.col("files") >= 2) & (F.col("peak") >= 0.55)), "high").otherwise("medium").alias("confidence"))
