"""User code on a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import as_list, require

PandasFn = Callable[[pd.DataFrame], pd.DataFrame]


def transform(df: DataFrame, fn: Callable[..., DataFrame], **params: object) -> DataFrame:
    """The preferred form: a function from DataFrame to DataFrame."""
    out = fn(df, **params)
    if not isinstance(out, DataFrame):
        raise TypeError("the function must return a DataFrame")
    return out


def transform_batches(df: DataFrame, fn: PandasFn, schema: str) -> DataFrame:
    """Row-local pandas code, applied to Arrow batches. ``fn`` must not depend
    on which rows share a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)


def transform_grouped(df: DataFrame, keys: str | list[str], partial: PandasFn,
                      partial_schema: str, merge: PandasFn, schema: str,
                      fan_in: int = 64) -> DataFrame:
    """Per-group pandas code in two parts, so that no task sees a whole group.

    ``partial`` turns the rows one group has in an Arrow batch into a few rows;
    ``merge`` turns the partial rows of a group into its result. Between the
    two, partials are merged with ``partial`` once more per (key, salt); it must
    therefore accept its own output (sums of sums, minima of minima).
    """
    names = as_list(keys)
    require(df, names)

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [partial(g) for _, g in batch.groupby(names, dropna=False, sort=False)]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    partials = df.mapInPandas(reduce_batches, partial_schema)
    salted = partials.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    merged = salted.groupBy(*names, "__salt").applyInPandas(
        lambda g: partial(g.drop(columns="__salt")), partial_schema)
    return merged.groupBy(*names).applyInPandas(merge, schema)
