"""All queries of the library by name, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``; ``sql`` is None where SQL cannot state the rows."""

    def register(f):
        if name in _ENTRIES:
            raise ValueError(f"two queries named {name}")
        _ENTRIES[name] = Entry(f, sql)
        return f

    return register


def _load() -> dict[str, Entry]:
    from loamgrid import plans

    plans.load()
    return _ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e.run for k, e in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in _load().items() if e.sql}
