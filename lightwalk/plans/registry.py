"""Queries by name, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function under its name. ``sql`` may use the named views, and begin with further ones."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views((", " if sql.lstrip().startswith("w_") or " as (" in sql.split("select")[0] else " ") + sql, *views) if views else sql
        return f

    return add


r6 = lambda c: F.round(c, 6)
