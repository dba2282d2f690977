"""Named queries over the driver tables, each with an equivalent SQL text.

A module registers a query with :func:`query`; ``__spark_entry__`` reads the
two dictionaries.  The SQL side is assembled as a ``WITH`` chain over the
derived tables of :mod:`newsiq.catalog.tables`.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "ingest",
    "parsing",
    "columns",
    "relational",
    "search",
    "functions",
    "near_duplicates",
    "evaluation",
    "monitoring",
    "products",
    "stateful",
)


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(t)`` under ``name``; ``t`` gives access to the tables.

    ``sql`` is the DuckDB text; ``tables`` lists the derived tables it uses.
    """
    from newsiq.catalog.tables import Tables, with_tables

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, tables)
        return fn

    return register


def load() -> None:
    """Import every catalog module, which fills the registries."""
    for module in MODULES:
        importlib.import_module(f"newsiq.catalog.{module}")
