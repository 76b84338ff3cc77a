"""Row order. Missing values come last in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(names: str | list[str] | None) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: list[str]) -> None:
    """Unknown column names are an error, as for a plain column lookup."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing} (available: {df.columns})")


def sort_keys(order_by: str | list[str], ascending: bool = True) -> list[Column]:
    names = as_list(order_by)
    return [F.col(n).asc_nulls_last() if ascending else F.col(n).desc_nulls_last()
            for n in names]


def sortable(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Columns usable as a tie-break: every orderable one not excluded."""
    unordered = (T.MapType, T.VariantType, T.NullType)
    return [f.name for f in df.schema
            if f.name not in exclude and not isinstance(f.dataType, unordered)]


def total_order(df: DataFrame, order_by: str | list[str] | None, ascending: bool = True,
                exclude: list[str] = ()) -> list[Column]:
    """``order_by`` followed by all other columns, so that ties are settled by
    the data and a rerun on other partitions gives the same rows."""
    first = as_list(order_by)
    return sort_keys(first, ascending) + sort_keys(sortable(df, [*first, *exclude]))


def position(order_by: list[str], ascending: bool, ties: list[str] = ()) -> Column:
    """A struct that grows with the row's place in the sort. Structs compare
    field by field with null lowest, so a flag in front of each field moves
    missing values to the end. Sorting downwards cannot negate a string; there
    the struct *falls* with the place and callers swap min and max."""
    fields: list[Column] = []
    for name in order_by:
        flag = F.col(name).isNull() if ascending else F.col(name).isNotNull()
        fields += [flag, F.col(name)]
    fields += [F.xxhash64(*ties)] if ties else []
    return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])


AT = "__at"


def with_position(df: DataFrame, order_by: list[str], columns: list[str],
                  ascending: bool = True) -> DataFrame:
    """Add the row's place (``position``). Ties are settled by a hash of the
    ``columns`` that are picked from, so that one row wins for all of them and no
    other column has to be read."""
    return df.withColumn(AT, position(order_by, ascending, sortable(df.select(*columns))))


def edge_value(df: DataFrame, column: str, highest: bool) -> Column:
    """The known value of a column at the highest or lowest place: an aggregate
    with a partial step. One struct compared as a whole is cheaper than a value
    kept next to its place."""
    c, at = F.col(column), F.col(AT)
    if not sortable(df.select(column)):
        return (F.max_by if highest else F.min_by)(c, F.when(c.isNotNull(), at))
    known = F.when(c.isNotNull(), F.struct(at, c.alias("v")))
    return (F.max if highest else F.min)(known).getField("v")
