"""How queries are registered: a function of the tables, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


SMALL_BYTES = 128 << 20


class Tables:
    """The tables of one folder, opened when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # its schema is read once
        return table

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are long texts: one below ``SMALL_BYTES`` is a row group or two, which few tasks would read, so its rows are dealt to all cores."""
        table = getattr(self, name)
        if int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_BYTES:
            return table
        return table.repartition(self.spark.sparkContext.defaultParallelism)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: registers ``body(tables)`` under ``name``, with its SQL if there is one."""

        def register(body: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: body(Tables(spark, folder))
            if sql:
                self.oracles[name] = sql
            return body

        return register
