"""Registry of checked queries: one Spark callable + (optionally) DuckDB SQL per operator.

``register(name, sql)`` decorates a ``(spark, sf_dir) -> DataFrame`` function.
Computed columns carry the same alias in both; doubles are rounded to 6
places in both engines (``r6``) so the driver's value hash is stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_ORDER: list[str] = []


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise KeyError(f"duplicate query {name}")
        _QUERIES[name] = fn
        _ORDER.append(name)
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable]:
    _load()
    return {k: _QUERIES[k] for k in _ORDER}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: _SQL[k] for k in _ORDER if k in _SQL}


def r6(c, name: str | None = None, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), places)
    return out.alias(name or (c if isinstance(c, str) else "value"))


_LOADED = False


def _load():
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    # import side effect: each module registers its queries
    from rowsift.plans import (q_curation, q_sampling, q_encode, q_completions,  # noqa: F401
                               q_quality, q_evaluate, q_report, q_sources, q_stream)
