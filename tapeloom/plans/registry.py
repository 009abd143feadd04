"""Registered queries: a name, the Spark query, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("highlights", "text", "retrieval", "history", "fusion", "cache", "sources", "streams")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tapeloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


#: Common table expressions that several queries' SQL begins with.
SEGMENTS = r"""
seg AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS INT) AS seg_idx, text, words, CAST(0.5 * words AS DOUBLE) AS duration,
         CAST(coalesce(sum(0.5 * words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + 2.5 * count(CASE WHEN turn % 4 = 0 AND turn > 0 THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) AS start
  FROM (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM conversations))"""
