"""The text index, path steps, hubs and derived imports on small cases."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.operators import graph as G
from repolith.operators import search as R
from repolith.operators import structure as O
from repolith.plans.indexing import symbol_chunks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_many_steps_up(spark):
    assert one(spark, P.normalised(F.lit("a/b/c/d/e/f/g/h/i/j/" + "../" * 9 + "x"))) == "a/x"
    assert one(spark, P.normalised(F.lit("../../a/./b/../c"))) == "../../a/c" and one(spark, P.normalised(F.lit("/a/../b"))) == "/b" and one(spark, P.normalised(F.lit("a/.."))) == ""


def test_directories(spark):
    given = {"": "", " a/b/ ": "a/b", "a\\b": "a/b", "a//b": "a/b", "../a": None, "a/./b": None, "/": ""}
    rows = spark.createDataFrame([(g,) for g in given], "g string").select("g", O.tree_directory(F.col("g")).alias("d"))
    assert {r.g: r.d for r in rows.collect()} == given


def test_hub_in_two_hops(spark):
    edges = [(1, f"c{i}", "hub") for i in range(40)] + [(1, "hub", f"t{j}") for j in range(5)] + [(1, "c0", "t0"), (1, "t1", "t1"), (2, "c9", "hub")]
    got = {tuple(r) for r in G.two_hops(spark.createDataFrame(edges, "graph_id int, src string, dst string")).select("graph_id", "node", "caller").collect()}
    assert got == {(1, f"t{j}", f"c{i}") for i in range(40) for j in range(5)} - {(1, "t0", "c0")}


def test_postings_count_every_term(spark):
    rows = [(1, 1, "a.py", None, "b a b  b x"), (1, 2, "b.py", "load", ""), (2, 3, "c.py", "b", "b" * 3 + " b")]
    passages = spark.createDataFrame(rows, "project_id long, chunk_id long, path string, symbol_name string, text string")
    folder = R.build_index(passages)
    got = {(r.chunk_id, r.term): r.tf for r in spark.read.parquet(f"{folder}/postings").collect()}
    assert got == {(c, t): n for _, c, _, _, text in rows for t, n in Counter(re.findall(r"\w+", text)).items()}
    assert {r.chunk_id: r.doc_len for r in spark.read.parquet(f"{folder}/passages").collect()} == {1: 5, 2: 0, 3: 2}
    hits = {r.chunk_id: r.score for r in R.search(folder, "b", spark=spark).collect()}
    assert set(hits) == {1, 3} and hits == {r.chunk_id: r.score for r in R.search(passages, "b").collect()}
    assert R.search(folder, "absent", spark=spark).count() == 0 and R.search(passages.limit(0), "b").count() == 0
    plan = R.search(folder, "b", spark=spark)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_chunks_of_symbols(spark):
    text = "".join(f"line {i}\n" for i in range(1, 201))
    symbols = spark.createDataFrame([(10, 1, "f", "function", 10, 12), (11, 1, "C", "class", 50, 180), (12, 1, "bad", "function", 900, 950), (13, 1, "none", "function", None, None)], "symbol_id long, file_id long, qualified_name string, kind string, start_line int, end_line int")
    files = spark.createDataFrame([(1, ".py"), (2, ".js"), (3, ".md"), (4, ".py")], "file_id long, suffix string")
    sources = spark.createDataFrame([(1, text), (2, "a\r\nb"), (3, text), (4, "\n\n")], "file_id long, content string")
    got = sorted((r.file_id, r.symbol_name or "", r.kind, r.start_line, r.end_line) for r in symbol_chunks(symbols, files, sources).collect())
    assert got == [(1, "", "module", 1, 6), (1, "", "module", 15, 46), (1, "", "module", 183, 200), (1, "C", "class", 47, 86), (1, "f", "function", 7, 14), (2, "", "file", 1, 2)]
