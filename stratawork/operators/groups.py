"""First, last and duplicate rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import all_known, nan_as_null
from ..functions.ordering import (as_list, edge_value, require, sortable, total_order,
                                  with_position)


def _backwards(df: DataFrame, order: list[str], ascending: bool, keys: list[str]) -> list[Column]:
    """The exact reverse of ``total_order``."""
    first = [F.col(c).desc_nulls_first() if ascending else F.col(c).asc_nulls_first()
             for c in order]
    rest = [F.col(c).desc_nulls_first() for c in sortable(df, [*order, *keys])]
    return first + rest


def _one_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark limits each group to one row before the shuffle
    (WindowGroupLimit), so a hot key does not travel whole. A constant order
    is never needed: callers pass at least one sort column."""
    window = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def _per_column(df: DataFrame, group_by: str | list[str], order_by: str | list[str],
                ascending: bool, last: bool) -> DataFrame:
    keys, order = as_list(group_by), as_list(order_by)
    require(df, [*keys, *order])
    values = [c for c in df.columns if c not in keys]
    picked = [edge_value(df, c, highest=last == ascending).alias(c) for c in values]
    rows = nan_as_null(df, df.columns).where(all_known(keys))
    placed = with_position(rows, order, values, ascending)
    return placed.groupBy(*keys).agg(*picked)


def last_per_group(df: DataFrame, group_by: str | list[str], order_by: str | list[str],
                   ascending: bool = True, whole_row: bool = False) -> DataFrame:
    """Last known value (NaN is missing) of each column per group, in the given order. Group
    columns come first, rows with a missing group key are left out. With
    ``whole_row`` the last row is kept as it is, missing cells included."""
    if whole_row:
        keys, order = as_list(group_by), as_list(order_by)
        require(df, [*keys, *order])
        rows = _one_row(df.where(all_known(keys)), keys, _backwards(df, order, ascending, keys))
        return rows.select(*keys, *[c for c in df.columns if c not in keys])
    return _per_column(df, group_by, order_by, ascending, last=True)


def first_per_group(df: DataFrame, group_by: str | list[str], order_by: str | list[str],
                    ascending: bool = True) -> DataFrame:
    """As ``last_per_group``, first known values."""
    return _per_column(df, group_by, order_by, ascending, last=False)


def deduplicate(df: DataFrame, subset: str | list[str] | None = None,
                keep: str | bool = "first", order_by: str | list[str] | None = None) -> DataFrame:
    """One row per ``subset`` (all columns if absent), the first or last in
    ``order_by``; ``keep=False`` drops every row that has a duplicate. Missing
    keys equal each other. Ties in ``order_by`` are settled by the other columns."""
    keys, order = as_list(subset), as_list(order_by)
    require(df, [*keys, *order])
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")
    if keep is False:
        keys = keys or df.columns
        held = [F.first(c).alias(c) for c in df.columns if c not in keys]
        once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *held)
        return once.where("__n = 1").select(*df.columns)
    if not keys or set(keys) == set(df.columns):
        return df.dropDuplicates()
    if not order:
        raise ValueError("order_by is needed to tell first from last: rows have no order")
    ranked = total_order(df, order, exclude=keys) if keep == "first" \
        else _backwards(df, order, True, keys)
    return _one_row(df, keys, ranked)


def flag_duplicates(df: DataFrame, subset: str | list[str] | None = None,
                    order_by: str | list[str] | None = None,
                    flag: str = "is_duplicate") -> DataFrame:
    """Mark every row but the first of each key.

    A hot key would put all its rows into one window task. So rows are ranked
    twice: first per (key, input partition), which splits the key over as many
    tasks as it came from; then the best rows of those parts are ranked per key
    while the others stay where they are. Exactly one row per key is unmarked,
    ties included.
    """
    keys, order = as_list(subset) or df.columns, as_list(order_by)
    require(df, [*keys, *order])
    ranked = total_order(df, order, exclude=keys) or [F.lit(0)]
    local = Window.partitionBy(*keys, "__part").orderBy(*ranked)
    best = Window.partitionBy(*keys, "__rest").orderBy(*ranked)
    return (
        df.withColumn("__part", F.spark_partition_id())
        .withColumn("__rest", F.when(F.row_number().over(local) > 1, F.col("__part")))
        .withColumn("__rank", F.row_number().over(best))
        .select(*df.columns,
                (F.col("__rest").isNotNull() | (F.col("__rank") > 1)).alias(flag)))
