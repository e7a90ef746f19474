"""Queries by name with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("bars", "records", "panels", "forecasts", "boards", "texts", "files", "streams", "gates", "audits", "analyses", "loads")


def query(sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(*names: str | tuple[str, Column], places: int = 6) -> list[Column]:
    """Columns rounded for results that are compared by value."""
    return [F.round(n[1] if isinstance(n, tuple) else F.col(n), places).alias(n[0] if isinstance(n, tuple) else n) for n in names]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"hindcast.plans.{m}")
