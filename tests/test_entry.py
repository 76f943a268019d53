"""The driver contract, and that the core does without the llm folder."""

from __future__ import annotations

import ast
import os

import __spark_entry__ as entry
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_nothing_imports_the_llm_folder():
    for folder, _, names in os.walk(os.path.join(ROOT, "repolith")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, name)).read())
                for node in ast.walk(tree):
                    modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in m.split(".") for m in modules), (folder, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "snapshot_id", "section", "item_key", "change_kind"] and df.count() >= 0
