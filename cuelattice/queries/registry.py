"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogs, more, problems, programs, scoring, sequences, wider

_MODULES = (problems, sequences, catalogs, scoring, programs, more, wider)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
