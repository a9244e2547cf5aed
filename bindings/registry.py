"""Registry of bound queries: a Spark callable and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from bindings import roles

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def bind(key: str, sql: str | None = None, using: str = ""):
    """Register ``f(spark, sf_dir)`` under ``key``. ``using`` names the role views ``sql`` reads."""
    def register(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = roles.with_views(using, sql)
        return f

    return register
