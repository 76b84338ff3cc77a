"""Maintaining a table from daily deliveries. ``previous`` is None on the first
run, and only then: a read error must not restart the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import as_list, require
from .groups import deduplicate
from .joins import anti_join
from .project import add_constant
from .sets import stack


def _other_dates(df: DataFrame, date_column: str, value: str) -> Column:
    """Rows of another date than ``value``, missing dates included. Written so
    that it can be pushed into the scan and prunes a date partition."""
    c, kind = F.col(date_column), df.schema[date_column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = F.lit(value).cast("date")
        return c.isNull() | (c < day.cast(kind)) | (c >= F.date_add(day, 1).cast(kind))
    wanted = F.lit(value) if isinstance(kind, T.StringType) else F.lit(value).cast(kind)
    return c.isNull() | (c != wanted)


def _dated(today: DataFrame, date_column: str, date_value: object) -> tuple[DataFrame, str]:
    if date_value is None:
        raise ValueError("the date of the delivery is required")
    return add_constant(today, date_column, str(date_value)), str(date_value)


def accumulate(previous: DataFrame | None, today: DataFrame, date_column: str,
               date_value: object) -> DataFrame:
    """History without the rows of ``date_value``, plus today's rows. Running a
    day again replaces that day. No shuffle."""
    today, value = _dated(today, date_column, date_value)
    if previous is None:
        return today
    return stack([previous.where(_other_dates(previous, date_column, value)), today])


def accumulate_dedup(previous: DataFrame | None, today: DataFrame, date_column: str,
                     date_value: object) -> DataFrame:
    """One row per distinct state (all columns but the date) with the earliest
    date it was seen on. Missing values count as equal."""
    today, _ = _dated(today, date_column, date_value)
    rows = today if previous is None else stack([previous, today])
    state = [c for c in rows.columns if c != date_column]
    return rows.groupBy(*state).agg(F.min(date_column).alias(date_column)).select(*rows.columns)


def upsert(previous: DataFrame | None, today: DataFrame, key: str | list[str],
           order_by: str | list[str] | None = None) -> DataFrame:
    """By key, today's row wins; keys not delivered today stay. If today repeats
    a key its last row in ``order_by`` wins (other columns settle ties, and
    decide alone when no order is given). ``previous`` is the output of an
    earlier run, hence unique by key."""
    keys = as_list(key)
    require(today, keys)
    rest = [c for c in today.columns if c not in keys]
    if rest:
        newest = deduplicate(today, keys, keep="last", order_by=as_list(order_by) or rest)
    else:
        newest = today.distinct()
    if previous is None:
        return newest
    require(previous, keys)
    return stack([anti_join(previous, today, keys), newest])
