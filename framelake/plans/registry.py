"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "chunk_norm_stats"
MODULES = ["episodes", "frames", "statistics", "arrays", "scalars", "quality", "streams", "evaluation", "selection", "recordings", "pairing", "nested", "chunk_ends", "motion", "hands", "stores", "validation", "reports"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: query name to the IDs of the operator inventory that it exercises
IDS: dict[str, list[str]] = {}


def query(ids: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], IDS[f.__name__] = f, ids.split()
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"framelake.plans.{name}")
