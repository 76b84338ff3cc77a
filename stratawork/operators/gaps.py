"""Regular time series: a full calendar per group, with gaps filled.

Plan for ``reindex_series``:

* rows already on the calendar pass through; they are neither joined with a
  calendar nor sorted, and the ends of the table are one subquery for the gaps only;
* a summary holds one row per (group, period) that occurs, built with partial
  aggregates. A group has at most as many of them as the calendar has periods,
  so a window over the summary is bounded whatever the size of a group or day;
* in that window every period sees its neighbours. The gap that follows it is
  generated with ``explode(sequence(...))``, already filled;
* only rows that have a missing cell in a carried column are joined with the
  summary.

Rows that share a group and a period have no order among themselves unless
``tie_break`` gives one: a missing cell first takes a value known in its own
period, then one from its neighbours.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import all_known, nan_as_null
from ..functions.ordering import as_list

# Frequency -> (characters of the date text used, step, output pattern)
FREQUENCIES = {
    "day": (10, "INTERVAL 1 DAY", "yyyy-MM-dd"),
    "week": (10, "INTERVAL 7 DAYS", "yyyy-MM-dd"),
    "month": (7, "INTERVAL 1 MONTH", "yyyy-MM"),
    "year": (4, "INTERVAL 1 YEAR", "yyyy"),
}
STRATEGIES = ("null", "zero", "ffill", "bfill", "interpolate")
PERIOD = "__period"


def _shift(period: Column, frequency: str, by: int) -> Column:
    if frequency in ("day", "week"):
        return F.date_add(period, by * (7 if frequency == "week" else 1))
    return F.add_months(period, by * (12 if frequency == "year" else 1))


def _ordinal(period: Column, frequency: str) -> Column:
    """Number of a period on the calendar; neighbours differ by one."""
    if frequency in ("day", "week"):
        days = F.unix_date(period)
        return days if frequency == "day" else F.floor(days / 7)
    year = F.year(period)
    return year if frequency == "year" else year * 12 + F.month(period)


def _first_on_grid(start: Column, frequency: str) -> Column:
    """First grid point not before ``start``: any day, Monday, first of month,
    first of January."""
    if frequency == "day":
        return start
    if frequency == "week":
        return F.next_day(F.date_sub(start, 1), "Mon")
    at = F.trunc(start, frequency)
    step = 1 if frequency == "month" else 12
    return F.when(at == start, at).otherwise(F.add_months(at, step))


def _last_on_grid(end: Column, frequency: str) -> Column:
    """Last grid point not after ``end``."""
    if frequency == "day":
        return end
    if frequency == "week":
        return F.date_sub(F.next_day(end, "Mon"), 7)
    return F.trunc(end, frequency)


def _steps(first: Column, last: Column, frequency: str) -> Column:
    """All grid points from one to another; null when there is none."""
    return F.when(first <= last, F.sequence(first, last, F.expr(FREQUENCIES[frequency][1])))


def period_sequence(start: Column, end: Column, frequency: str) -> Column:
    """Array of all grid points in [start, end]; null when there is none."""
    return _steps(_first_on_grid(start, frequency), end, frequency)


def calendar_grid(groups: DataFrame, start: Column, end: Column, frequency: str,
                  name: str = PERIOD) -> DataFrame:
    """Every row of ``groups`` with every period in [start, end]."""
    return groups.select("*", F.explode(period_sequence(start, end, frequency)).alias(name))


def period_of(df: DataFrame, date_column: str, frequency: str) -> Column:
    """The date of a row, cut to the precision of the frequency."""
    kind = df.schema[date_column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        day = F.col(date_column).cast("date")
        return F.trunc(day, frequency) if frequency in ("month", "year") else day
    text = F.col(date_column).cast("string")
    return F.substring(text, 1, FREQUENCIES[frequency][0]).cast("date")


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _plan(df: DataFrame, values: list[str], fill: str | Mapping | None) -> dict[str, str]:
    """Strategy per column. Named columns come before the default; a strategy
    that does not apply to a column's type leaves it as it is."""
    spec = {"strategy": fill} if isinstance(fill, str) else dict(fill or {})
    default, named = spec.get("strategy", "null"), dict(spec.get("columns", {}))
    chosen = {c: named.get(c, default) for c in values}
    for c, s in chosen.items():
        if s not in STRATEGIES:
            raise ValueError(f"fill strategy must be one of {STRATEGIES}, got '{s}'")
        text = isinstance(df.schema[c].dataType, T.StringType)
        if (s == "interpolate" and not _is_numeric(df, c)) or \
                (s == "zero" and not (text or _is_numeric(df, c))):
            chosen[c] = "null"
    return chosen


def _zero(df: DataFrame, name: str) -> Column:
    return F.lit(0 if _is_numeric(df, name) else "").cast(df.schema[name].dataType)


def _known_in_period(c: str, strategy: str, tie_break: list[str]) -> Column:
    last = strategy != "bfill"
    if not tie_break:
        return (F.max if last else F.min)(c)
    at = F.when(F.col(c).isNotNull(), F.struct(*tie_break, c))
    return (F.max_by if last else F.min_by)(F.col(c), at)


def _match(keys: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, other)])


def reindex_series(df: DataFrame, date_column: str = "date",
                   group_by: str | list[str] | None = None, frequency: str = "day",
                   start: str | None = None, end: str | None = None,
                   fill: str | Mapping | None = None,
                   tie_break: str | list[str] | None = None) -> DataFrame:
    """Complete each group to one row per period between ``start`` and ``end``
    (default: first and last date of the whole table).

    ``fill`` is a strategy or ``{"strategy": default, "columns": {name: strategy}}``
    with null, zero, ffill, bfill or interpolate (linear by position, edges take
    the nearest value). Fills also apply to cells missing in the data, NaN included. Rows off
    the calendar are left out; several rows of one period all stay. The date
    comes back as text in the precision of the frequency.
    """
    groups, ties = as_list(group_by), as_list(tie_break)
    if frequency not in FREQUENCIES:
        raise ValueError(f"no such frequency: '{frequency}'; there are {list(FREQUENCIES)}")
    for c in [*groups, date_column, *ties]:
        if c not in df.columns:
            raise ValueError(f"no column '{c}' to order or group the series by; the table has {df.columns}")
    values = [c for c in df.columns if c not in [*groups, date_column]]
    strategy = _plan(df, values, fill)
    carried = [c for c in values if strategy[c] in ("ffill", "bfill", "interpolate")]
    dated = nan_as_null(df, carried + [c for c in values if strategy[c] == "zero"]).withColumn(
        PERIOD, period_of(df, date_column, frequency))
    # The ends of the table bound no row, only gaps: one subquery, in one column.
    found = F.struct(F.min(PERIOD).alias("lo"), F.max(PERIOD).alias("hi"))
    low = F.lit(start).cast("date") if start else F.col("__ends").getField("lo")
    high = F.lit(end).cast("date") if end else F.col("__ends").getField("hi")
    on_grid = F.col(PERIOD).isNotNull() & (F.col(PERIOD) == _first_on_grid(F.col(PERIOD), frequency))
    if start:
        on_grid = on_grid & (F.col(PERIOD) >= low)
    if end:
        on_grid = on_grid & (F.col(PERIOD) <= high)
    rows = dated.where(on_grid)

    def finish(part: DataFrame, cells: dict[str, Column]) -> DataFrame:
        """Put zero fills in and restore names and column order."""
        out = []
        for c in values:
            cell = cells.get(c, F.col(c))
            if strategy[c] == "zero":
                cell = F.coalesce(cell, _zero(df, c))
            elif strategy[c] == "interpolate":
                cell = cell.cast("double")
            out.append(cell.alias(c))
        date = F.date_format(PERIOD, FREQUENCIES[frequency][2]).alias(date_column)
        return part.select(*groups, date, *out)

    # One row per period that occurs; rows off the calendar make a row without
    # period, which keeps their group and stands before the first period.
    places = dated.withColumn(PERIOD, F.when(on_grid, F.col(PERIOD)))
    known = [F.when(F.col(PERIOD).isNotNull(), _known_in_period(c, strategy[c], ties)).alias(c)
             for c in carried]
    if known:
        summary = places.groupBy(*groups, PERIOD).agg(*known)
    else:
        summary = places.select(*groups, PERIOD).distinct()
    if not groups:
        start_row = df.sparkSession.range(1).select(F.lit(None).cast("date").alias(PERIOD))
        summary = summary.unionByName(start_row, allowMissingColumns=True)

    ordered = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.col(PERIOD).asc_nulls_first())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    from_here = ordered.rowsBetween(0, Window.unboundedFollowing)
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    neighbours: list[Column] = []
    for i, c in enumerate(carried):
        point = F.when(F.col(c).isNotNull(), F.struct(
            _ordinal(F.col(PERIOD), frequency).alias("p"), F.col(c).alias("v")))
        neighbours += [F.last(point, ignorenulls=True).over(so_far).alias(f"__low{i}"),
                       F.first(point, ignorenulls=True).over(from_here).alias(f"__here{i}"),
                       F.first(point, ignorenulls=True).over(later).alias(f"__high{i}")]
    linked = summary.select(*groups, PERIOD, F.lead(PERIOD).over(ordered).alias("__next"),
                            F.row_number().over(ordered).alias("__place"), *neighbours)
    bounded = linked if start and end else linked.withColumn("__ends", dated.agg(found).scalar())

    def fills(before: Column | None) -> dict[str, Column]:
        """Fill values at PERIOD, given whether it lies before or after the
        summary row it comes from (None: on it)."""
        out = {}
        for i, c in enumerate(carried):
            lo, here, hi = (F.col(f"__{n}{i}") for n in ("low", "here", "high"))
            if before is not None:
                lo, hi = F.when(~before, lo), F.when(before, here).otherwise(hi)
            else:
                hi = here
            if strategy[c] == "ffill":
                out[c] = lo.getField("v")
            elif strategy[c] == "bfill":
                out[c] = hi.getField("v")
            else:
                v0, v1 = lo.getField("v").cast("double"), hi.getField("v").cast("double")
                p0, p1 = lo.getField("p"), hi.getField("p")
                along = F.try_divide(v1 - v0, p1 - p0) \
                    * (_ordinal(F.col(PERIOD), frequency) - p0)
                out[c] = F.coalesce(v0 + along, v0, v1)
        return out

    first, last = _first_on_grid(low, frequency), _last_on_grid(high, frequency)
    here, none = F.col(PERIOD), F.array().cast("array<date>")
    gap_after = _steps(F.when(here.isNull(), first).otherwise(_shift(here, frequency, 1)),
                       F.coalesce(_shift(F.col("__next"), frequency, -1), last), frequency)
    gap_before = F.when((F.col("__place") == 1) & here.isNotNull(),
                        _steps(first, _shift(here, frequency, -1), frequency))
    links = [f"__{n}{i}" for i in range(len(carried)) for n in ("low", "here", "high")]
    gaps = F.concat(F.coalesce(gap_before, none), F.coalesce(gap_after, none))
    missing = bounded.select(*groups, *links, here.alias("__from"), F.explode(gaps).alias(PERIOD))
    empty = {c: F.lit(None).cast(df.schema[c].dataType) for c in values}
    before = F.coalesce(F.col(PERIOD) < F.col("__from"), F.lit(False))
    added = finish(missing, {**empty, **fills(before)})
    if not carried:
        return finish(rows, {}).unionByName(added)

    complete = all_known(carried)
    keys = [*groups, PERIOD]
    mirror = [f"__s{i}" for i in range(len(keys))]
    at_period = fills(None)
    lookup = linked.where(here.isNotNull()).select(
        *[F.col(k).alias(m) for k, m in zip(keys, mirror)],
        *[at_period[c].alias(f"__f{i}") for i, c in enumerate(carried)])
    patched = rows.where(~complete).join(lookup, _match(keys, mirror), "left")
    cells = {c: F.coalesce(F.col(c).cast("double") if strategy[c] == "interpolate" else F.col(c),
                           F.col(f"__f{i}")) for i, c in enumerate(carried)}
    return finish(rows.where(complete), {}).unionByName(added).unionByName(finish(patched, cells))
