"""Symbols, imports, syntax flags and static calls of source files.

Python goes through the standard library's parser, scripts through a bracket-
aware scan of their declarations. One row in, one row per symbol, import or call
out; the three kinds share one schema (``row_type``) so that a file is parsed
once and split afterwards.

Defined results: null texts and unknown suffixes give no rows; a text above the
limit or one that does not parse gives one ``issue`` row (and, for scripts, what
could be read).
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import spread

PARSE_BYTES = 2 << 20
_DDL = "project_id bigint, file_id bigint, row_type string, name string, qualified_name string, kind string, start_line int, end_line int"
_NAMES = ["project_id", "file_id", "row_type", "name", "qualified_name", "kind", "start_line", "end_line"]
_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int32()]

Row = tuple[str, str, str, str, int, int]


def python_rows(text: str) -> list[Row]:
    """(row_type, name, qualified_name, kind, start_line, end_line) of a Python text; raises SyntaxError."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out: list[Row] = []

    def called(node: ast.expr) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := called(node.value)):
            return f"{head}.{node.attr}"
        return None

    stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
    while stack:
        node, outer, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            names, inside = outer, in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                names, inside = (*outer, child.name), in_class or kind == "class"
                out.append(("symbol", child.name, ".".join(names), kind, child.lineno, child.end_lineno or child.lineno))
            elif isinstance(child, ast.Import):
                out += [("import", a.name, a.asname or a.name.split(".")[0], "module", child.lineno, child.lineno) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out += [("import", module, f"{a.asname or a.name}={a.name}", "symbol", child.lineno, child.lineno) for a in child.names]
            elif isinstance(child, ast.Call) and (name := called(child.func)):
                out.append(("call", name, ".".join(outer), "call", child.lineno, child.lineno))
            stack.append((child, names, inside))
    return sorted(out, key=lambda r: (r[4], r[0], r[2], r[1]))


_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)")
_FROM = re.compile(r"(?m)^[ \t]*import\b(?!\s*\()(?P<what>[^;'\"]*?)(?:\bfrom\s*)?(['\"])(?P<module>[^'\"\n]+)\2")
_REQUIRE = re.compile(r"\brequire\s*\(\s*(['\"])(?P<module>[^'\"\n]+)\1\s*\)")
_DECLARED = re.compile(
    r"(?P<class>\b(?:class|interface)\s+(?P<c>[A-Za-z_$][\w$]*)[^{};]*\{)|(?P<function>\bfunction\s*\*?\s*(?P<f>[A-Za-z_$][\w$]*)\s*[(<])"
    r"|(?P<bound>\b(?:const|let|var)\s+(?P<b>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={]+)?=>|[A-Za-z_$][\w$]*\s*=>))"
    r"|(?P<method>(?m:^[ \t]+)(?:(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+)*(?P<m>(?!(?:if|for|while|switch|catch|return|function|new|throw|typeof|await)\b)#?[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\([^;{}]*?\)\s*(?::[^;{}=]+)?[{;])"
)
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "require", "import", "await", "super"}


def script_rows(text: str) -> list[Row]:
    """The same of a JavaScript or TypeScript text; never raises."""
    bare = _COMMENT.sub(lambda m: m.group() if m.group(1) and "\n" not in m.group() else re.sub(r"[^\n]", " ", m.group()), text)
    blank = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    line = lambda at: text.count("\n", 0, at) + 1
    closing: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            closing[opened.pop()] = m.start()
    out: list[Row] = []
    classes: list[tuple[int, int, str]] = []
    for m in _DECLARED.finditer(blank):
        if m.group("class"):
            brace = blank.index("{", m.start("class"))
            end = closing.get(brace, len(text) - 1)
            kind = "interface" if m.group("class").lstrip().startswith("interface") else "class"
            classes.append((brace, end, m.group("c")))
            out.append(("symbol", m.group("c"), m.group("c"), kind, line(m.start("class")), line(end)))
            continue
        name = m.group("f") or m.group("b") or m.group("m")
        holder = next((c for b, e, c in reversed(classes) if b < m.start() < e), None)
        if m.group("method") and holder is None:
            continue
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        brace = blank.find("{", m.end() - 1 if m.group("method") else m.end())
        stop = blank.find(";", m.end() - 1)
        end = closing.get(brace, m.end()) if brace >= 0 and (stop < 0 or brace < stop or not m.group("method")) else m.end()
        qualified = f"{holder}.{name}" if holder else name
        out.append(("symbol", name, qualified, "method" if holder and m.group("method") else "function", line(at), line(min(end, len(text) - 1))))
    for pattern in (_FROM, _REQUIRE):
        for m in pattern.finditer(bare):
            what = (m.groupdict().get("what") or "").strip()
            out.append(("import", m.group("module"), what, "symbol" if "{" in what else "module", line(m.start("module")), line(m.start("module"))))
    for m in _CALL.finditer(blank):
        if m.group(1).split(".")[0] not in _NO_CALL:
            out.append(("call", m.group(1), "", "call", line(m.start()), line(m.start())))
    return sorted(set(out), key=lambda r: (r[4], r[0], r[2], r[1]))


def parse_text(text: str | None, suffix: str) -> list[Row]:
    if text is None:
        return []
    if len(text.encode()) > PARSE_BYTES:
        return [("issue", "Source file is larger than the parser limit.", "", "issue", 1, 1)]
    if suffix == ".py":
        try:
            return python_rows(text.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError) as error:
            at = getattr(error, "lineno", None) or 1
            return [("issue", f"Unexpected token near line {at}.", "", "issue", at, at)]
    return script_rows(text)


def parse_files(files: DataFrame) -> DataFrame:
    """files (project_id, file_id, suffix, content) -> rows of all kinds; imports are de-duplicated per (module, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, file, suffix, text in zip(*[batch.column(n).to_pylist() for n in ("project_id", "file_id", "suffix", "content")]):
                rows += [(project, file, *r) for r in dict.fromkeys(parse_text(text, suffix))]
            columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    rows = files.where(F.col("suffix").isin(".py", ".js", ".jsx", ".ts", ".tsx")).select("project_id", "file_id", "suffix", "content")
    return spread(rows, "file_id").mapInArrow(run, _DDL)


def bound_calls(parsed: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """Static call binding of Python: caller file and scope, line, called symbol's file and name.

    A call is bound if its first name is imported once in the file (an ambiguous
    name is dropped), the import resolves to a file of the project, and that
    file defines the symbol once. ``index`` is the module index.
    """
    imports = parsed.where("row_type = 'import' and kind = 'symbol' and qualified_name like '%=%'")
    names = imports.select("project_id", "file_id", F.substring_index("qualified_name", "=", 1).alias("local"), F.substring_index("qualified_name", "=", -1).alias("original"), F.col("name").alias("module"))
    single = names.groupBy("project_id", "file_id", "local").agg(F.min(F.struct("module", "original")).alias("t"), F.count_distinct("module", "original").alias("n")).where("n = 1")
    modules = index.select("project_id", F.col("alias").alias("module"), F.col("file_id").alias("target_file"))
    targets = single.select("project_id", "file_id", "local", F.col("t.module").alias("module"), F.col("t.original").alias("original")).join(modules, ["project_id", "module"])
    defined = parsed.where("row_type = 'symbol'").groupBy("project_id", F.col("file_id").alias("target_file"), F.col("qualified_name").alias("original")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    calls = parsed.where("row_type = 'call'").select("project_id", "file_id", F.col("name").alias("local"), F.col("qualified_name").alias("scope"), F.col("start_line").alias("line"))
    own = parsed.where("row_type = 'symbol' and kind = 'function'").select("project_id", "file_id", F.col("name").alias("local"), F.lit(True).alias("shadowed")).distinct()
    bound = calls.join(targets, ["project_id", "file_id", "local"]).join(own, ["project_id", "file_id", "local"], "left").where("shadowed is null").join(defined, ["project_id", "target_file", "original"])
    return bound.select("project_id", "file_id", "scope", "line", "target_file", F.col("original").alias("target_name"))
