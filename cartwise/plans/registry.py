"""Registered queries: a Spark job over the given tables and, where ANSI SQL
can say the same, the statement that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwise.sources.adapters import Tables, with_views

Job = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register `job` under `name`; `sql` may use the adapter views."""

    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: job(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return job

    return register
