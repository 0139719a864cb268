"""Registered queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` with the SQL that must give the same rows."""

    def register(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register
