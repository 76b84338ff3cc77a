"""Joins on same-named keys. Null keys match each other.

Strategy is Catalyst's: no broadcast hint is given anywhere, a side is
broadcast only when its size is below the session's threshold. What is decided
here is the shape of *outer* joins. Adaptive execution can split a hot key on
both sides of an inner join, but only on the preserved side of an outer join.
A left join whose right side may repeat keys is therefore built as

    inner join  UNION ALL  left rows without a partner (left join with distinct keys)

which gives the same rows while each part can be split. Both parts read the same
shuffle of the left side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import as_list, require

HOW = ("inner", "left", "right", "outer")


def _on(left_keys: list[str], right_keys: list[str]) -> Column:
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left_keys, right_keys)]
    return reduce(lambda a, b: a & b, pairs)


def _hidden(keys: list[str]) -> list[str]:
    return [f"__key_{i}" for i in range(len(keys))]


def _distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(h) for k, h in zip(keys, _hidden(keys))]).distinct()


def anti_join(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    keys = as_list(on)
    require(df, keys)
    require(other, keys)
    return df.join(_distinct_keys(other, keys), _on(keys, _hidden(keys)), "left_anti")


def semi_join(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    keys = as_list(on)
    require(df, keys)
    require(other, keys)
    return df.join(_distinct_keys(other, keys), _on(keys, _hidden(keys)), "left_semi")


def with_membership(df: DataFrame, column: str, other: DataFrame, other_column: str,
                    flag: str = "is_member") -> DataFrame:
    """Add a boolean: does ``column`` occur in ``other.other_column``?"""
    known = other.select(F.col(other_column).alias("__member")).distinct()
    known = known.withColumn("__found", F.lit(True))
    out = df.join(known, F.col(column).eqNullSafe(F.col("__member")), "left")
    return out.select(*df.columns, F.coalesce("__found", F.lit(False)).alias(flag))


def join(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner",
         suffixes: tuple[str, str] = ("_x", "_y"), unique_right: bool = False) -> DataFrame:
    """Equi-join on same-named columns. Keys appear once; other names present
    on both sides get ``suffixes``. ``unique_right`` states that ``other`` has
    one row per key (a dimension), which allows the plain left join."""
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}, got '{how}'")
    keys = as_list(on)
    require(df, keys)
    require(other, keys)
    shared = {c for c in df.columns if c in other.columns} - set(keys)
    if shared and suffixes[0] == suffixes[1]:
        raise ValueError(f"columns overlap and the suffixes are equal: {sorted(shared)}")
    left_names = [c + suffixes[0] if c in shared else c for c in df.columns]
    extra = [c for c in other.columns if c not in keys]
    right_names = [c + suffixes[1] if c in shared else c for c in extra]
    if len({*left_names, *right_names}) < len(left_names) + len(right_names):
        raise ValueError(f"suffixes {suffixes} produce duplicate columns")

    # The right side gets names of its own; result names are given after the
    # joins, so that the parts of an outer join read the same two shuffles.
    hidden = _hidden(keys)
    cells = [f"__cell_{i}" for i in range(len(extra))]
    right = other.select(*[F.col(k).alias(h) for k, h in zip(keys, hidden)],
                         *[F.col(c).alias(n) for c, n in zip(extra, cells)])
    condition = _on(keys, hidden)

    def named(part: DataFrame, from_right: bool = False, alone: bool = False) -> DataFrame:
        """The result columns of a part; ``alone`` rows lack the other side."""
        out = []
        for c, n in zip(df.columns, left_names):
            if c in keys:
                cell = F.col(hidden[keys.index(c)] if from_right else c)
            else:
                cell = F.lit(None).cast(df.schema[c].dataType) if alone and from_right else F.col(c)
            out.append(cell.alias(n))
        for c, n, cell in zip(extra, right_names, cells):
            missing = alone and not from_right
            out.append((F.lit(None).cast(other.schema[c].dataType) if missing else F.col(cell))
                       .alias(n))
        return part.select(*out)

    if how == "inner":
        return named(df.join(right, condition, "inner"))
    if how in ("left", "outer") and unique_right:
        parts = [named(df.join(right, condition, "left"))]
    else:
        parts = [named(df.join(right, condition, "inner"))]
        if how in ("left", "outer"):
            parts.append(named(_without(df, keys, other.select(*keys)), alone=True))
    if how in ("right", "outer"):
        parts.append(named(_without(right, hidden, df.select(*keys)), from_right=True, alone=True))
    return reduce(DataFrame.unionByName, parts)


def _without(df: DataFrame, keys: list[str], others: DataFrame) -> DataFrame:
    """Rows whose key is not among ``others``. An anti join would be moved below
    the projections of ``df`` and could no longer share the shuffle of the inner
    join; a left join with the distinct keys and a marker stays in place."""
    names = [f"__other_{i}" for i in range(len(keys))]
    known = others.toDF(*names).distinct().withColumn("__known", F.lit(True))
    return df.join(known, _on(keys, names), "left").where(F.col("__known").isNull())


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """Left-join a fact table to dimensions one after another. Each dimension
    has one row per key."""
    for dim, keys in dims:
        fact = join(fact, dim, keys, how="left", unique_right=True)
    return fact
