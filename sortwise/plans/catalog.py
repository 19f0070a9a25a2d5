"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver's tables (or relations Spark derives from them),
so its work grows with the data.  Array results are flattened to strings and
every computed column is aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import sqlgen as S

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str  # SURVEY ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


# imports kept below the registry so query modules can use ``register``
from . import queries_core  # noqa: E402,F401
from . import queries_more  # noqa: E402,F401
from . import queries_stream  # noqa: E402,F401
