"""Name -> query and, where SQL can express it, name -> oracle SQL.

Modules of ``repolith.plans`` add pairs with ``register``; the keys are the
operator ids of the survey in lower case plus a short word.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Modules that register queries, in the order in which they are listed.
MODULES = ("problems", "structure", "search", "graph", "history", "relations", "imports", "indexing")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"repolith.plans.{module}")
