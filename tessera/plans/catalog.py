"""Registered queries: every operator applied to whole tables, with an equivalent DuckDB query where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> tuple[dict, dict]:
    from . import classification, corpora, matrices, modelling, roundtrips, runs, texts  # noqa: F401  each registers its queries

    return QUERIES, ORACLE_SQL
