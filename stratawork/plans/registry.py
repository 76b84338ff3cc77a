"""Named queries over the test tables, each with SQL that must give the same
rows (where SQL can state it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``<dir>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query '{name}' is registered twice")
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None = None) -> Callable:
    """Register the decorated function under its own name."""
    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        register(build.__name__, build, sql)
        return build
    return wrap


def exact(df: DataFrame, *columns: str) -> DataFrame:
    """Money as decimals: sums of doubles depend on the order of the rows. Up to
    18 digits, products included, Spark computes them as long integers."""
    return df.withColumns({c: F.col(c).cast("decimal(12,2)") for c in columns})


def in_cents(df: DataFrame, *columns: str) -> DataFrame:
    """Money as whole cents: their mean is one division of exact numbers."""
    return df.withColumns({c: F.rint(F.col(c) * 100).cast("bigint") for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def day_text(c: str) -> Column:
    return F.col(c).cast("date").cast("string")


def time_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
