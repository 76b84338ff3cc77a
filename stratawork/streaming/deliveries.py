"""Chunked deliveries: a bounded stream of chunks becomes one table change.

Each micro-batch is landed under ``staging/batch=<id>/`` and overwrites that
directory, so a batch repeated after a failure leaves no duplicates. When the
stream has ended, everything landed is applied in one step: one rewrite per
delivery instead of one per micro-batch. A delivery that broke off is finished
by calling the function again with the same staging and checkpoint folders; a
new delivery takes new ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import accumulate
from ..operators.project import add_constant
from ..sources import files, maintained
from ..sources.versions import Commit, Store

BATCH = "__batch"


def chunks(spark: SparkSession, path: str, schema: Any, fmt: str = "parquet",
           files_per_batch: int | None = None, **options: Any) -> DataFrame:
    """A file-source stream over the chunks of one delivery."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def land(stream: DataFrame, staging: str, checkpoint: str) -> DataFrame:
    """Run the stream to its end; returns everything landed by this delivery."""
    spark, schema = stream.sparkSession, stream.schema

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staging}/{BATCH}={batch_id}")

    query = stream.writeStream.foreachBatch(save) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    landed = spark.read.schema(schema)
    try:
        return landed.parquet(staging).select(*schema.names)
    except Exception as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_append(store: Store, dataset: str, stream: DataFrame, staging: str, checkpoint: str,
                  metadata: Mapping[str, Any] | None = None) -> Commit:
    """All chunks as one new version; the commit carries the row count."""
    return store.write(dataset, land(stream, staging, checkpoint), metadata)


def stream_upsert(store: Store, dataset: str, stream: DataFrame, key: str | list[str],
                  staging: str, checkpoint: str, delivery: str,
                  order_by: str | list[str] | None = None) -> Commit:
    """Upsert the chunks into the latest version, of which only the buckets that the
    delivery touches are written anew. ``delivery`` is stored with the version;
    applying the same delivery twice in a row is skipped."""
    landed = land(stream, staging, checkpoint)
    return maintained.upsert(store, dataset, landed, key, order_by, {"delivery": delivery})


def stream_accumulate(store: Store, dataset: str, stream: DataFrame, date_column: str,
                      date_value: Any, staging: str, checkpoint: str, delivery: str) -> Commit:
    """Accumulate the chunks as the delivery of ``date_value`` into the latest
    version. Works for any delivery, and writes the whole table anew."""
    landed = land(stream, staging, checkpoint)
    last = store.latest(dataset)
    inputs = [(dataset, last["version"])] if last is not None else []
    table = accumulate(store.read_or_none(dataset), landed, date_column, date_value)
    return store.write(dataset, table, {"delivery": delivery}, inputs)


def stream_accumulate_in_place(stream: DataFrame, table: str, date_column: str, date_value: Any,
                               staging: str, checkpoint: str) -> DataFrame:
    """The same for a table partitioned by date of which one partition is
    replaced and the others stay untouched, so the cost is that of one day.
    Every delivered row must be of ``date_value``; rows of other dates would
    have to be added to partitions that a rerun cannot tell apart, and are an
    error here. Returns the table."""
    if date_value is None:
        raise ValueError("the date of the delivery is required")
    spark, value = stream.sparkSession, str(date_value)
    landed = land(add_constant(stream, date_column, value), staging, checkpoint)
    same = F.col(date_column).cast("string").eqNullSafe(F.lit(value))
    counts = landed.agg(F.count(F.lit(1)).alias("all"), F.count_if(~same).alias("other")).first()
    if counts["other"]:
        raise ValueError(f"{counts['other']} delivered rows are not of {value}")
    if counts["all"]:
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(date_column).parquet(table)
    else:
        files.remove(spark, f"{table}/{date_column}={value}")
    return spark.read.schema(landed.schema).parquet(table)
