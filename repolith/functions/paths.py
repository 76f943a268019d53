"""Path expressions: everything stays inside generated code on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_path(path: Column) -> Column:
    """Backslashes turned to slashes."""
    return F.translate(path, "\\", "/")


def suffix(path: Column) -> Column:
    """The suffix with its dot; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem_path(path: Column) -> Column:
    """The path without its suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def normalised(path: Column) -> Column:
    """``a/./b/../c`` -> ``a/c``; ``..`` above the start stay."""
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & up(done), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def package_root(target: Column) -> Column:
    """First part of a JavaScript package name, two parts if it is scoped."""
    parts = F.filter(F.split(target, "/"), lambda p: p != "")
    scoped = F.try_element_at(parts, F.lit(1)).startswith("@") & (F.size(parts) > 1)
    return F.coalesce(F.when(scoped, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.try_element_at(parts, F.lit(1))), F.lit(""))
