"""Pages and previews of a table, and its checksum."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import finite_columns
from ..operators.ranking import page


def read_slice(df: DataFrame, order_by: str | list[str], limit: int, offset: int = 0) -> DataFrame:
    return page(df, order_by, limit, offset)


def preview(df: DataFrame, order_by: str | list[str], limit: int = 10,
            offset: int = 0) -> DataFrame:
    """A page with NaN and infinities as null."""
    return finite_columns(read_slice(df, order_by, limit, offset))


def _row_hash(df: DataFrame) -> Column:
    """64 bits of a row that do not depend on the order of its columns."""
    cells = []
    for name in sorted(df.columns):
        complex_ = isinstance(df.schema[name].dataType, (T.MapType, T.VariantType))
        cell = F.to_json(F.col(f"`{name}`")) if complex_ else F.col(f"`{name}`")
        cells.append(F.struct(F.lit(name), cell.isNull(), cell))
    return F.xxhash64(*cells)


def content_checksum(df: DataFrame) -> DataFrame:
    """One row: row count and a hash of the content that depends neither on row
    nor on column order. The sum keeps duplicate rows apart, which xor alone
    would cancel."""
    return df.select(_row_hash(df).alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")
    ).select("n_rows", F.sha2(F.concat_ws(":", "n_rows", F.col("s").cast("string"), "x"), 256)
             .alias("checksum"))


def bucket_measures(df: DataFrame, bucket: Column, buckets: int) -> list[Column]:
    """Aggregates of ``content_checksum`` for each bucket (a number from 0, which a row
    keeps through a change), to be taken in passing: they merge by sum and xor."""
    at, h, out = F.pmod(bucket, F.lit(buckets)), _row_hash(df), []
    for i in range(buckets):
        own = F.when(at.eqNullSafe(F.lit(i)) | (at.isNull() if i == 0 else F.lit(False)), h)
        out += [F.count(own).alias(f"__n{i}"), F.sum(own.cast("decimal(20,0)")).alias(f"__s{i}"),
                F.bit_xor(own).alias(f"__x{i}")]
    return out


def bucket_digests(measured: Mapping[str, Any], buckets: int) -> dict[str, str]:
    """Digest of each bucket that has rows, from measured aggregates."""
    return {str(i): f"{measured[f'__n{i}']}:{measured[f'__s{i}']}:{measured[f'__x{i}']}"
            for i in range(buckets) if measured[f"__n{i}"]}
