"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    """Import every query module so that it registers its queries."""
    import importlib
    import pkgutil

    import sessionlens.llm as here

    for module in pkgutil.iter_modules(here.__path__):
        if module.name.startswith("query_"):
            importlib.import_module(f"{here.__name__}.{module.name}")
