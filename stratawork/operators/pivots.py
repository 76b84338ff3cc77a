"""Long to wide and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import all_known
from ..functions.ordering import as_list, require
from .aggregates import measure

PIVOT_FUNCTIONS = ("sum", "mean", "count", "min", "max")


def pivot(df: DataFrame, index: str | list[str], columns: str, values: str,
          aggfunc: str = "sum", fill_value: Any = 0,
          column_values: list[Any] | None = None) -> DataFrame:
    """One row per ``index``, one column per value of ``columns``; cells no row
    falls into get ``fill_value``. Rows with a missing key are left out.

    Give ``column_values`` to save the job that looks them up. Without it Spark
    fails above ``spark.sql.pivotMaxValues`` instead of building a table of
    unbounded width.
    """
    if aggfunc not in PIVOT_FUNCTIONS:
        raise ValueError(f"aggfunc must be one of {PIVOT_FUNCTIONS}, got '{aggfunc}'")
    keys = as_list(index)
    require(df, [*keys, columns, values])
    rows = df.where(all_known([*keys, columns]))
    if aggfunc in ("mean", "min", "max"):
        rows = rows.where(F.col(values).isNotNull())
    wide = rows.groupBy(*keys).pivot(columns, column_values).agg(measure(values, aggfunc))
    if fill_value is None:
        return wide
    cells = wide.columns[len(keys):]
    return wide.select(*keys, *[F.coalesce(F.col(f"`{c}`"), F.lit(fill_value)).alias(c)
                                for c in cells])


def unpivot(df: DataFrame, id_vars: str | list[str], value_vars: str | list[str] | None = None,
            var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row per (row, value column). ``value_vars`` defaults to all columns
    that are not ids. Values of different kinds are turned into text."""
    ids = as_list(id_vars)
    melted = as_list(value_vars) or [c for c in df.columns if c not in ids]
    require(df, [*ids, *melted])
    kinds = [df.schema[c].dataType for c in melted]
    same = all(k == kinds[0] for k in kinds)
    numeric = all(isinstance(k, T.NumericType) for k in kinds)
    if not (same or numeric):
        df = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in melted])
    return df.unpivot(ids, melted, var_name, value_name)
