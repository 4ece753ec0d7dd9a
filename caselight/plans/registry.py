"""All registered queries: a plan builder and, where SQL can express it, the same query for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .lenses import Tables, duck


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """A query by its plan over the tables of a folder, and its SQL with lenses as ``<name>``."""
    QUERIES[name] = Query(lambda spark, sf_dir: build(Tables(spark, sf_dir)), duck(sql) if sql else None)


for _family in ("documents", "crossdoc", "scoring", "detectors", "cases", "similar", "store"):
    importlib.import_module(f"{__package__}.queries_{_family}")
