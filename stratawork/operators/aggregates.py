"""Grouped aggregates. Every function here has a partial form, so a hot group
is reduced on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import all_known, nan_as_null
from ..functions.ordering import as_list, edge_value, require, with_position
from ..functions.scalars import day_span, ratio

FUNCTIONS = ("sum", "mean", "count", "min", "max", "std", "first", "last")


def measure(column: str, func: str) -> Column:
    """One aggregate that needs no order. Missing values are skipped; the sum of
    none is 0 and the deviation of one value is null."""
    c = F.col(column)
    simple = {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
              "std": F.stddev_samp}
    if func == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if func in simple:
        return simple[func](c)
    if func in ("first", "last"):
        raise ValueError(f"'{func}' needs order_by: rows have no order of their own")
    raise ValueError(f"unknown function '{func}' (one of {FUNCTIONS})")


def aggregate(df: DataFrame, group_by: str | list[str] | None, agg: Mapping[str, str],
              order_by: str | list[str] | None = None) -> DataFrame:
    """Group by keys, one function per column; results keep the column names.
    Rows with a missing key are left out; NaN is missing. ``first`` and ``last`` are the known
    values at the two ends of ``order_by``."""
    keys, order = as_list(group_by), as_list(order_by)
    require(df, [*keys, *agg, *order])
    ordered = bool(order) and not {"first", "last"}.isdisjoint(agg.values())
    rows = nan_as_null(df, [*keys, *agg, *order]).where(all_known(keys))
    rows = with_position(rows, order, list(agg)) if ordered else rows
    measures = [(edge_value(df, c, f == "last") if ordered and f in ("first", "last")
                 else measure(c, f)).alias(c) for c, f in agg.items()]
    return rows.groupBy(*keys).agg(*measures)


def agg_multi(df: DataFrame, fields: list[str], func: str,
              group_by: str | list[str] | None = None,
              order_by: str | list[str] | None = None) -> DataFrame:
    """One function over several columns, per group or over the whole table."""
    return aggregate(df, group_by, {f: func for f in fields}, order_by)


def count_rows(df: DataFrame, group_by: str | list[str], name: str = "n_rows") -> DataFrame:
    """Rows per group, whatever they hold."""
    keys = as_list(group_by)
    require(df, keys)
    return nan_as_null(df, keys).where(all_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    """Rows per value, most frequent first."""
    return count_rows(df, column, name).orderBy(F.col(name).desc(), F.col(column).asc())


def distinct(df: DataFrame, columns: str | list[str] | None = None) -> DataFrame:
    names = as_list(columns)
    require(df, names)
    return (df.select(*names) if names else df).distinct()


def group_kpi(df: DataFrame, date: str, quantity: str, amount: str) -> DataFrame:
    """Per calendar year: total quantity, rounded total amount, days between
    first and last date (both counted), and amount per unit."""
    totals = (
        nan_as_null(df, [quantity, amount]).where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"))
        .agg(measure(quantity, "sum").alias("quantity"),
             measure(amount, "sum").alias("__amount"),
             day_span(F.min(date), F.max(date)).alias("days")))
    return totals.select(
        "year", "quantity", F.round("__amount", 2).alias("amount"), "days",
        ratio("__amount", "quantity", 4).alias("unit_cost"))
