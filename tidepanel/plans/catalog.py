"""The registry of queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; without SQL only its rows can be checked from outside."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def round_all(frame: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Columns rounded, so that the order of sums can't show."""
    return frame.withColumns({c: F.round(c, n) for c, n in digits.items()})


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import backtest_queries, model_queries, panel_queries, research_queries  # noqa: F401

    return QUERIES, ORACLES
