"""Two-valued comparisons.

A comparison with a missing value is False, except "not equal", which is True.
So ``~gt("x", 5)`` keeps rows where x is missing. Each helper is written as
IS [NOT] NULL plus a plain comparison rather than with ``coalesce``: Catalyst
can still push both halves into a Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def known_value(df: DataFrame, name: str) -> Column:
    """The column, its missing values null: in floating columns NaN is missing too."""
    if not is_floating(df, name):
        return F.col(name)
    return F.nullif(F.col(name), F.lit(float("nan")).cast(df.schema[name].dataType))


def nan_as_null(df: DataFrame, names: list[str]) -> DataFrame:
    """The named floating columns with null for NaN. Other columns stay as they are,
    so that filters on them still reach the scan."""
    floating = [n for n in dict.fromkeys(names) if is_floating(df, n)]
    return df.withColumns({n: known_value(df, n) for n in floating}) if floating else df


def _known(c: str | Column, other: Any) -> Column:
    known = col(c).isNotNull()
    return known & other.isNotNull() if isinstance(other, Column) else known


def eq(c: str | Column, v: Any) -> Column:
    return _known(c, v) & (col(c) == v)


def ne(c: str | Column, v: Any) -> Column:
    return ~eq(c, v)


def gt(c: str | Column, v: Any) -> Column:
    return _known(c, v) & (col(c) > v)


def ge(c: str | Column, v: Any) -> Column:
    return _known(c, v) & (col(c) >= v)


def lt(c: str | Column, v: Any) -> Column:
    return _known(c, v) & (col(c) < v)


def le(c: str | Column, v: Any) -> Column:
    return _known(c, v) & (col(c) <= v)


def between(c: str | Column, low: Any, high: Any) -> Column:
    return ge(c, low) & le(c, high)


def is_in(c: str | Column, values: list) -> Column:
    """Membership; a None in ``values`` matches missing cells."""
    present = [v for v in values if v is not None]
    found = col(c).isNotNull() & col(c).isin(present) if present else F.lit(False)
    return found | col(c).isNull() if len(present) < len(values) else found


def all_known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def truth(predicate: Column) -> Column:
    """Turn an arbitrary SQL predicate into a two-valued one."""
    return F.coalesce(predicate, F.lit(False))
