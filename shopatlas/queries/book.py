"""A list of queries: functions of (spark, sf_dir) and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures


class Tables:
    """Given and derived tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name)


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Decorator: register a function of Tables under its name."""

        def keep(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[key] = fixtures.with_tables(sql)
            return f

        return keep
