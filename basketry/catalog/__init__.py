"""Every operator as a query over the supplied tables, with an independent DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from basketry.catalog.fixtures import Inputs
from basketry.catalog.oracle import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}
#: The texts as given, for texts that build on others.
TEXTS: dict[str, str] = {}

SECTIONS = [
    "io", "cleaning", "joining", "aggregating", "ordering", "quality", "marts", "retention", "demand", "modelling", "text", "decisions",
]


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(inputs) -> DataFrame` under `name`; `covers` lists inventory ids, `sql` is its DuckDB text."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        COVERS[name] = covers.split()
        if sql is not None:
            TEXTS[name] = sql
            ORACLES[name] = with_ctes(sql)
        return fn

    return add


def load() -> None:
    for section in SECTIONS:
        import_module(f"basketry.catalog.{section}")
