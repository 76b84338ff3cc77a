"""Number clean-up for previews and chart values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """NaN and both infinities become null (floating columns only)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_columns(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(c)).alias(c) if c in floating else F.col(c)
                       for c in df.columns])


def chart_number(c: Column) -> Column:
    """A double rounded to 6 places, null when not finite."""
    return F.round(finite(c.cast("double")), 6)
