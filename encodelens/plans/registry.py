"""The registry of queries: a name, a function of the views, and the DuckDB twin if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from encodelens.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A moment to which the derived tables' times relate.
NOW = 1_710_000_000


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name; sql may name tables and views, and {now}."""

    def put(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql.replace("{now}", str(NOW)))
        return f

    return put
