"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with its SQL if there is any."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        assert run.__name__ not in QUERIES, run.__name__
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries and their SQL; the modules register themselves on import."""
    from wicker.queries import command_queries, evaluation_queries, graph_queries, resolve_queries, source_queries, store_queries, text_queries, vector_queries  # noqa: F401

    return QUERIES, ORACLES
