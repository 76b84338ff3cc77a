"""The tables behind charts. Drawing is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import chart_number
from ..functions.nulls import all_known, nan_as_null
from ..functions.ordering import require, sort_keys, total_order
from .aggregates import measure


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _as_category(df: DataFrame, names: list[str | None]) -> DataFrame:
    """Numeric categories are grouped and sorted as text."""
    numeric = {n for n in names if n and isinstance(df.schema[n].dataType, T.NumericType)}
    return df.select(*[F.col(c).cast("string").alias(c) if c in numeric else F.col(c)
                       for c in df.columns])


def _value(y: str | None, agg: str) -> Column:
    return F.count(F.lit(1)) if agg == "count" else measure(y, agg)


def _axis_order(x: str, sort: str | None, by_other: bool) -> list[Column]:
    down = sort == "desc"
    return sort_keys((["__by"] if by_other else []) + [x], not down)


def chart_xy(df: DataFrame, x: str, y: str | None = None, agg: str = "sum",
             sort: str | None = None, sort_field: str | None = None,
             limit: int | None = None, name: str = "value") -> DataFrame:
    """Bar or line: one value per category. Order: by ``sort_field`` if given,
    else by category; counts without any sort come largest first."""
    require(df, [c for c in (x, y if agg != "count" else None, sort_field) if c])
    if sort_field == x:
        sort_field, sort = None, sort or "asc"
    rows = _as_category(nan_as_null(df, df.columns), [x]).where(F.col(x).isNotNull())
    if sort_field and agg != "count":
        grouped = rows.where(F.col(sort_field).isNotNull()).groupBy(
            x, F.col(sort_field).alias("__by")).agg(_value(y, agg).alias("__v"))
    elif sort_field:
        grouped = rows.groupBy(x).agg(_value(y, agg).alias("__v"), F.min(sort_field).alias("__by"))
    else:
        grouped = rows.groupBy(x).agg(_value(y, agg).alias("__v"))
    order = _axis_order(x, sort, bool(sort_field))
    if agg == "count" and not sort and not sort_field:
        order = [F.col("__v").desc(), *order]
    number = F.col("__v") if agg == "count" else chart_number(F.col("__v"))
    return _first(grouped.orderBy(*order), limit).select(x, number.alias(name))


def chart_xy_color(df: DataFrame, x: str, color: str, y: str | None = None, agg: str = "sum",
                   sort: str | None = None, sort_field: str | None = None,
                   limit: int | None = None, colors: list[str] | None = None) -> DataFrame:
    """Category by colour matrix, 0 where a pair does not occur. Colours become
    columns; give ``colors`` to save the job that looks them up."""
    require(df, [c for c in (x, color, y if agg != "count" else None, sort_field) if c])
    keys = [x, color] + ([sort_field] if sort_field and sort_field not in (x, color) else [])
    rows = _as_category(nan_as_null(df, df.columns), [x, color]).where(all_known(keys))
    cells = rows.groupBy(*keys).agg(_value(y, agg).alias("__v"))
    by = F.col(sort_field) if sort_field else F.lit(0)
    cells = cells.withColumn("__by", by)
    # the order key of a category must not depend on the colour
    wide = cells.groupBy(x).pivot(color, colors).agg(
        F.sum("__v").alias("v"), F.min("__by").alias("by"))
    names = [c[:-2] for c in wide.columns[1:] if c.endswith("_v")]
    lowest = F.array_min(F.array(*[F.col(f"`{n}_by`") for n in names]))
    ordered = wide.withColumn("__by", lowest).orderBy(*_axis_order(x, sort, bool(sort_field)))
    return _first(ordered, limit).select(x, *[
        F.coalesce(chart_number(F.col(f"`{n}_v`")), F.lit(0.0)).alias(n) for n in names])


def chart_pie(df: DataFrame, x: str, y: str, agg: str = "sum", limit: int | None = None) -> DataFrame:
    """Name, value and share of the whole; with ``limit`` the first slices, their
    shares still those of the whole."""
    require(df, [x, y])
    rows = _as_category(nan_as_null(df, df.columns), [x]).where(F.col(x).isNotNull())
    slices = rows.groupBy(x).agg(chart_number(measure(y, agg)).alias("value"))
    whole = slices.agg(F.sum("value")).scalar()
    return _first(slices.orderBy(*sort_keys(x)), limit).select(
        F.col(x).cast("string").alias("name"), "value",
                         F.round(F.try_divide(F.col("value"), whole), 6).alias("share"))


def histogram_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number from 1, right-closed, the lowest value included. Edges are
    ``low + i * width``; a first guess is corrected by one against them, which
    costs the same for any number of bins."""
    width = (high - low) / bins
    guess = F.least(F.greatest(F.ceil(F.try_divide(v - low, width)), F.lit(1)), F.lit(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, high).otherwise(low + i * width)
    moved = F.when((guess > 1) & (v <= edge(guess - 1)), guess - 1) \
        .when((guess < bins) & (v > edge(guess)), guess + 1).otherwise(guess)
    return moved.cast("int")


def chart_histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], empty bins kept, missing dropped. The
    first lower edge lies 0.1 % of the range below the minimum. When all values
    are equal the range is widened by 0.1 % on both sides."""
    require(df, [x])
    values = df.select(F.col(x).cast("double").alias("v")) \
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    pad = F.when(F.col("lo") == 0, 0.001).otherwise(F.abs("lo") * 0.001)
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"), flat.alias("flat"))
    # One copy of the subquery per branch: a column, whose fields are then used.
    span = ends.select(F.struct("lo", "hi", "flat")).scalar()
    low, high = F.col("__ends.lo"), F.col("__ends.hi")
    counts = values.withColumn("__ends", span).groupBy(histogram_bin(F.col("v"), low, high, bins).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    i = F.col("bin")
    first = F.when(F.col("__ends.flat"), low).otherwise(low - (high - low) * 0.001)
    edges = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), span.alias("__ends")).where("__ends.lo IS NOT NULL")
    return edges.join(counts, "bin", "left").select(
        "bin", F.when(i == 1, first).otherwise(low + (i - 1) * width).alias("lower"),
        F.when(i == bins, high).otherwise(low + i * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def chart_scatter(df: DataFrame, x: str, y: str, order_by: str | list[str],
                  limit: int | None = None) -> DataFrame:
    """The complete (x, y) pairs in ``order_by``, the first ``limit`` if given."""
    pairs = _first(nan_as_null(df, [x, y]).where(all_known([x, y])).orderBy(*total_order(df, order_by)), limit)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return pairs.select(*[chart_number(F.col(c)).alias(c) if c in numeric else F.col(c)
                          for c in (x, y)])


def chart_radar(df: DataFrame, axes: list[str], group_by: str | None = None,
                agg: str = "sum") -> DataFrame:
    """One row per group and axis with the value and the axis end, 1.2 times the
    largest value (1 where that is 0). At least three axes; count means sum."""
    if len(axes) < 3:
        raise ValueError(f"radar charts show three axes or more, got {axes}")
    require(df, [*axes, *([group_by] if group_by else [])])
    func = "sum" if agg == "count" else agg
    df = nan_as_null(df, df.columns)
    measures = [measure(a, func).alias(a) for a in axes]
    if group_by:
        rows = _as_category(df, [group_by]).where(F.col(group_by).isNotNull())
        wide = rows.groupBy(F.col(group_by).cast("string").alias("name")).agg(*measures)
    else:
        wide = df.agg(*measures).select(F.lit("Total").alias("name"), *axes)
    size = F.col if group_by else F.abs
    ends = wide.agg(F.struct(*[F.max(size(a)).alias(a) for a in axes])).scalar()

    def end(a: str) -> Column:
        top = F.col("__ends").getField(a)
        return F.when(top != 0, chart_number(top) * 1.2).otherwise(1.0)
    return wide.withColumn("__ends", ends).select("name", F.inline(F.array(*[
        F.struct(F.lit(a).alias("axis"), chart_number(F.col(a)).alias("value"),
                 end(a).alias("axis_max")) for a in axes])))


def chart_combo(df: DataFrame, x: str, series: list[tuple[str, str]], sort: str | None = None,
                sort_field: str | None = None, limit: int | None = None) -> DataFrame:
    """Several measures per category, each ``(column, function)``, in one
    aggregate and one category order. Results are named ``column_function``."""
    if not series:
        raise ValueError("a combo chart needs at least one series")
    require(df, [x, *([sort_field] if sort_field else []),
                 *[c for c, f in series if f != "count"]])
    rows = _as_category(nan_as_null(df, df.columns), [x]).where(F.col(x).isNotNull())
    by = [F.min(sort_field).alias("__by")] if sort_field else []
    names = [f"{c}_{f}" for c, f in series]
    grouped = rows.groupBy(x).agg(
        *[_value(c, f).alias(n) for (c, f), n in zip(series, names)], *by)
    ordered = _first(grouped.orderBy(*_axis_order(x, sort, bool(sort_field))), limit)
    return ordered.select(F.col(x).cast("string").alias(x),
                          *[chart_number(F.col(n)).alias(n) for n in names])
