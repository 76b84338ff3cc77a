"""Tables of a SQL database over JDBC (the driver jar is the cluster's)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_options(url: str, table: str, schema: str | None = None,
                  partition_column: str | None = None, lower: Any = None, upper: Any = None,
                  partitions: int | None = None, **options: Any) -> dict[str, str]:
    """Reader options. Without a partition column one task reads the table; its
    bounds only set the stride, rows outside them are still read."""
    out = {"url": url, "dbtable": f"{schema}.{table}" if schema else table}
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("partition_column needs lower, upper and partitions")
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower),
                "upperBound": str(upper), "numPartitions": str(partitions)}
    return out | {k: str(v) for k, v in options.items()}


def scan_table(spark: SparkSession, url: str, table: str, **kwargs: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(url, table, **kwargs)).load()


def scan_query(spark: SparkSession, query: str, url: str | None = None,
               views: Mapping[str, DataFrame] | None = None, **options: Any) -> DataFrame:
    """A SELECT as a dataset: run by the database at ``url``, or by Spark on
    ``views`` (name -> DataFrame) and session tables."""
    if url is None:
        return spark.sql(query, **dict(views or {})) if views else spark.sql(query)
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def sink_table(df: DataFrame, url: str, table: str, **options: Any) -> None:
    """A new table; fails if it exists."""
    df.write.format("jdbc").mode("errorifexists") \
        .options(url=url, dbtable=table, **options).save()


def sink_chunk(df: DataFrame, batch_id: int, url: str, table: str,
               batch_column: str | None = None, **options: Any) -> None:
    """One chunk of a stream (for ``foreachBatch``): the first replaces the
    table, later ones append. A batch repeated after a failure is appended again
    unless the database rejects it; give ``batch_column`` so that it can."""
    if batch_column:
        df = df.withColumn(batch_column, F.lit(batch_id))
    df.write.format("jdbc").mode("overwrite" if batch_id == 0 else "append") \
        .options(url=url, dbtable=table, **options).save()
