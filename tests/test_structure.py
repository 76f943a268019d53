"""Import resolution, trees, paging and incremental states on small repositories."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from repolith.functions import paths as P
from repolith.functions import scalars as S
from repolith.operators import evidence, incremental, parsing, pipeline, search, structure
from repolith.sources import scan

FILES = ["app/__init__.py", "app/models/user.py", "src/app/tools.py", "src/web/main.ts", "src/web/lib/util.tsx", "src/web/lib/index.js", "README.md", "tests/test_x.py"]


def files(spark, paths=FILES):
    rows = [(1, n, p, "." + p.rsplit(".", 1)[-1], 3) for n, p in enumerate(paths)]
    return spark.createDataFrame(rows, "project_id long, file_id long, path string, suffix string, line_count int")


def imports(spark, rows):
    return spark.createDataFrame([(1, n, p, "." + p.rsplit(".", 1)[-1], t, 1) for n, (p, t) in enumerate(rows)], "project_id long, file_id long, source_path string, suffix string, target_module string, line_number int")


@pytest.mark.parametrize("source,target,want", [
    ("app/models/user.py", "app.models.user", "app/models/user.py"), ("app/models/user.py", "app.tools", "src/app/tools.py"), ("app/models/user.py", ".user", "app/models/user.py"), ("app/models/user.py", "..models.user", "app/models/user.py"),
    ("app/models/user.py", "os", None), ("src/web/main.ts", "./lib/util", "src/web/lib/util.tsx"), ("src/web/main.ts", "./lib", "src/web/lib/index.js"), ("src/web/lib/util.tsx", "../main", "src/web/main.ts"), ("src/web/main.ts", "../../../x", None), ("src/web/main.ts", "react", None),
])
def test_resolution(spark, source, target, want):
    got = structure.resolve_imports(imports(spark, [(source, target)]), files(spark)).collect()
    assert len(got) == 1 and (FILES[got[0].resolved_file_id] if got[0].resolved_file_id is not None else None) == want


def test_ambiguous_alias_is_dropped(spark):
    index = structure.python_module_index(files(spark, ["a/b.py", "src/a/b.py"])).collect()
    assert {r.alias for r in index} == {"src.a.b"}


def test_directory_listing(spark):
    top = {(r.name, r.is_dir, r.file_count) for r in structure.list_directory(files(spark)).collect()}
    assert top == {("app", True, 2), ("src", True, 4), ("tests", True, 1), ("README.md", False, 1)}
    assert {r.name for r in structure.list_directory(files(spark), "src/web/").collect()} == {"main.ts", "lib"}


def test_pages_join_up_to_the_listing(spark):
    rows = files(spark).select("path")
    pages = [r.path for k in range(3) for r in structure.page(rows, ["path"], offset=3 * k, limit=3).collect()]
    assert pages == sorted(FILES)
    last = structure.page(rows, ["path"], offset=6, limit=3).collect()
    assert {(r.total, r.has_more) for r in last} == {(8, False)}


@pytest.mark.parametrize("path,want", [("test.py", "test"), ("spec.ts", "test"), ("src/test_helpers.py", "test"), ("src/main.py", "production"), ("web/dist/a.js", "generated"), ("a/x.min.js", "generated"), ("tests/dist/a.py", "test"), ("a/b.spec.ts", "test"), ("", "production")])
def test_scope(spark, path, want):
    assert spark.range(1).select(S.code_scope(F.lit(path))).first()[0] == want


def test_paths_and_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.normalised(F.lit("a/b/../c/./d"))) == "a/c/d" and one(P.package_root(F.lit("@a/b/c"))) == "@a/b" and one(P.package_root(F.lit(""))) == ""
    assert one(S.code_tokens(F.lit("parseHTTPIndex_v2 = 12; 数据库"))) == ["parsehttpindex_v2", "parse", "httpindex", "v2", "12", "数据库", "数据", "据库"]
    assert one(S.text_lines(F.lit("a\nb"))) == 2 and one(S.text_lines(F.lit(""))) == 0 and one(S.text_lines(F.lit("a\n"))) == 1
    assert one(S.unit_vector(F.array(F.lit(0.0), F.lit(0.0)))) == [] and one(S.reference_points(F.lit(8), 8, 20)) == 20 and one(S.reference_points(F.lit(0), 8, 20)) == 0


def test_incremental_states_and_rewrite(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "file_id long, content_hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d"), (5, None)], "file_id long, content_hash string")
    changes = incremental.classify_changes(old, new, ["file_id"])
    assert {(r.file_id, r.state) for r in changes.collect()} == {(1, "deleted"), (2, "unchanged"), (3, "changed"), (4, "added"), (5, "added")}
    table = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "file_id long, v string")
    fresh = spark.createDataFrame([(2, "n"), (3, "n"), (4, "n")], "file_id long, v string")
    assert {tuple(r) for r in incremental.rewrite(table, fresh, changes, ["file_id"]).collect()} == {(2, "o"), (3, "n"), (4, "n")}
    assert incremental.classify_changes(old.limit(0), new.limit(0), ["file_id"]).count() == 0


def test_search_ranks_and_excludes(spark):
    rows = [(1, 1, "b_symbol.py", "locate_orbit", "def locate(): orbit needle"), (1, 2, "a_module.py", None, "orbit needle"), (1, 3, "c.py", None, "nothing here"), (1, 4, "dist/x.min.js", None, "orbit needle orbit")]
    passages = spark.createDataFrame(rows, "project_id long, chunk_id long, path string, symbol_name string, text string")
    got = [r.chunk_id for r in search.search(passages, "orbit needle").orderBy(F.col("score").desc()).collect()]
    assert set(got) == {1, 2, 4} and got[-1] == 4 and got[0] == 1
    assert search.search(passages, "").count() == 0 and search.search(passages.limit(0), "orbit").count() == 0


def test_line_windows(spark):
    text = "\n".join(f"l{i}" for i in range(1, 171)) + "\n"
    got = search.line_windows(spark.createDataFrame([(1, text), (2, ""), (3, " \n\n")], "id long, content string")).collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 80), (69, 148), (137, 170)]


def test_window_selection(spark):
    rows = [(1, 7, 1, 20, "alpha beta", 1), (1, 7, 21, 30, "gamma", 2), (1, 7, 100, 110, "delta", 3), (1, 7, 300, 310, "eps", 4), (1, 8, 1, 5, "alpha beta gamma", 5), (1, 9, 1, 5, "omega", 6)]
    df = spark.createDataFrame(rows, "question long, file_id long, start_line int, end_line int, snippet string, rank int")
    got = [(r.file_id, r.start_line, r.end_line) for r in evidence.select_windows(df).orderBy("place").collect()]
    assert got == [(7, 1, 30), (7, 100, 110), (9, 1, 5)]


PY = "import os, json as j\nfrom app.models import User\n\nclass A:\n    def m(self):\n        return User(1)\n\ndef f():\n    return j.loads('1')\n"
TS = "import { a } from './a';\nconst fs = require('fs');\ninterface I { go(): void; }\nclass C {\n  run(x: number) { return a(x); }\n}\nconst arrow = (x) => x;\n"


def test_python_rows():
    rows = parsing.python_rows(PY)
    assert [(r[1], r[3], r[4]) for r in rows if r[0] == "symbol"] == [("A", "class", 4), ("m", "method", 5), ("f", "function", 8)]
    assert [(r[1], r[4]) for r in rows if r[0] == "import"] == [("json", 1), ("os", 1), ("app.models", 2)]
    assert ("call", "User", "A.m", "call", 6, 6) in rows
    assert parsing.parse_text("def f(:\n", ".py")[0][0] == "issue" and parsing.parse_text(None, ".py") == []


def test_script_rows():
    rows = parsing.script_rows(TS)
    assert [(r[1], r[4]) for r in rows if r[0] == "import"] == [("./a", 1), ("fs", 2)]
    assert {(r[2], r[3]) for r in rows if r[0] == "symbol"} >= {("I", "interface"), ("C", "class"), ("C.run", "method"), ("arrow", "function")}


def repository(tmp_path):
    base = tmp_path / "repo"
    (base / "app").mkdir(parents=True)
    (base / "node_modules").mkdir()
    (base / "app" / "models.py").write_text("class User:\n    pass\n\ndef load():\n    return User()\n")
    (base / "app" / "main.py").write_text("from app.models import load\n\ndef run():\n    return load()\n")
    (base / "README.md").write_text("# x\n")
    (base / "node_modules" / "i.js").write_text("1")
    (base / "blob.py").write_bytes(b"a\0b")
    return base


def test_scan_import_and_binding(spark, tmp_path):
    scanned = scan.scan_folder(spark, str(repository(tmp_path)))
    got = {r.relative_path: (r.line_count, r.language) for r in scanned.collect()}
    assert got == {"app/models.py": (5, "Python"), "app/main.py": (4, "Python"), "README.md": (1, None)}
    tables = pipeline.import_repository(scanned, 7)
    assert {r.qualified_name for r in tables["symbols"].collect()} == {"User", "load", "run"}
    assert tables["imports"].where("resolved_file_id is not null").count() == 1
    bound = parsing.bound_calls(tables["parsed"], tables["files"], structure.python_module_index(tables["files"])).collect()
    assert [(r.scope, r.line, r.target_name) for r in bound] == [("run", 4, "load")]
    assert '"findings":[]' in tables["snapshot"].first().data_json
    assert "# Repository report" in pipeline.markdown_report(tables["files"], tables["findings"], tables["scores"])


def make_zip(path, names):
    with zipfile.ZipFile(path, "w") as z:
        for n in names:
            z.writestr(n, "x = 1\n")


def test_archive(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    make_zip(path, ["root/a.py", "root/b/c.ts", "root/node_modules/x.js", "root/d.bin"])
    assert {r.relative_path for r in scan.scan_archive(spark, path).collect()} == {"a.py", "b/c.ts"}


@pytest.mark.parametrize("names", [[], ["../x.py"], ["/abs.py"], ["A.py", "a.PY"]])
def test_unsafe_archives(names):
    data = io.BytesIO()
    make_zip(data, names)
    with pytest.raises(ValueError), zipfile.ZipFile(data) as z:
        scan.checked_entries(z)


def test_upload_budget(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("../c", 1), ("/d", 1), ("e", 5)], "relative_path string, size_bytes long")
    assert {r.relative_path for r in scan.admitted_uploads(rows, max_total=10).collect()} == {"a", "b"}


def test_saved_index_and_promotion(spark, tmp_path):
    passages = spark.createDataFrame([(1, 1, "alpha beta"), (2, 5, "gamma")], "project_id long, chunk_id long, text string")
    pipeline.save_index(passages, str(tmp_path / "index"))
    pipeline.save_index(passages.where("project_id = 1"), str(tmp_path / "index"))  # project 2 stays
    assert pipeline.load_index(spark, str(tmp_path / "index"), passages).count() == 3
    grown = passages.unionByName(spark.createDataFrame([(1, 9, "new")], passages.schema))
    assert {r.project_id for r in pipeline.load_index(spark, str(tmp_path / "index"), grown).collect()} == {2}
    pipeline.promote(passages, str(tmp_path / "t"))
    pipeline.promote(passages.limit(1), str(tmp_path / "t"))
    assert pipeline.current(spark, str(tmp_path / "t")).count() == 1


def test_streams(spark, tmp_path):
    from repolith.streaming.events import follow_scans, windowed

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, content_hash string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    known = spark.createDataFrame([(1, "z"), (3, "c")], "file_id long, content_hash string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    follow_scans(stream, lambda: known, lambda df, n: seen.extend(map(tuple, df.collect())), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert set(seen) == {(1, "changed"), (2, "added"), (3, "deleted")}
    events = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' event_type, 1.0D value")
    assert windowed(events, watermark=None).first().events == 1
