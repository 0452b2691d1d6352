"""All relational, event-time and table queries: name -> callable and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import estimates, families, layouts, relational, scalars, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (relational, scalars, families, estimates, layouts, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
