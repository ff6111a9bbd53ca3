"""Where queries are registered with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Data:
    """The tables of a folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @cached_property
    def listing(self) -> DataFrame:
        return tables.listing(self.spark, self.sf_dir)

    @cached_property
    def alert(self) -> DataFrame:
        return tables.alert(self.spark, self.sf_dir)

    @cached_property
    def sent(self) -> DataFrame:
        return tables.sent(self.spark, self.sf_dir)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


def query(sql: str | None = None, listings: bool = False, name: str | None = None):
    """Register a function of Data under its name. sql is the oracle; with listings=True it may use listing, alert, sent."""

    def put(f: Callable[[Data], DataFrame]):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            SQL[name or f.__name__] = tables.with_listings(sql) if listings else sql.strip()
        return f

    return put
