"""Queries by name, and the SQL that says the same on another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trolley.plans.tables import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None, *ctes: str):
    """Register a query under its function's name, with its SQL over the named CTEs; None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is None:
            return f
        whole = sql(text, *ctes) if ctes else text
        SQL[f.__name__] = re.sub(r"count_if\(([^()]*)\)", r"CAST(count_if(\1) AS BIGINT)", whole)
        return f

    return add
