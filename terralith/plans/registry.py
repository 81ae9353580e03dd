"""Named queries over the driver's tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES: tuple[str, ...] = tuple(f"terralith.plans.{m}" for m in ("potential", "survey", "properties", "shapes", "formats", "optimise", "streams", "extras", "runs", "exchange", "inversions"))


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under ``name``."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = fn
        if sql:
            _ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    from importlib import import_module

    for module in _MODULES:
        import_module(module)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
