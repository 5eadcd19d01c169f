"""Where queries register: a name, a function of the tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.sources.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *uses: str):
    """Registers ``function(tables)`` under ``name``; ``uses`` are the derived relations of the SQL."""

    def keep(function):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_fixtures(sql, *uses)
        return function

    return keep
