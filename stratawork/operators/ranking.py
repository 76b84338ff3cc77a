"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import as_list, position, require, sort_keys, sortable, total_order


def sort(df: DataFrame, order_by: str | list[str], ascending: bool = True) -> DataFrame:
    """Global sort, missing values last in both directions."""
    require(df, as_list(order_by))
    return df.orderBy(*sort_keys(order_by, ascending))


def top_k(df: DataFrame, order_by: str | list[str], k: int,
          ascending: bool = False) -> DataFrame:
    """First ``k`` rows in order (each task keeps only its own best ``k``)."""
    require(df, as_list(order_by))
    return df.orderBy(*total_order(df, order_by, ascending)).limit(k)


def sort_by_other(df: DataFrame, x: str, sort_field: str, ascending: bool = True) -> DataFrame:
    """Distinct categories in the order of another column (month names by month
    number). A category with several values takes the smallest."""
    require(df, [x, sort_field])
    order = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.min(sort_field).alias(sort_field))
    return order.orderBy(*sort_keys([sort_field, x], ascending))


#: Rows before a page that are simply ranked; the place of deeper pages is sought.
RANKED = 20_000
#: Ranges that a column is cut into at a time, and how many characters of a text cut it.
RANGES, PREFIX = 256, 64


def page(df: DataFrame, order_by: str | list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` in order, ties settled by the other columns.

    With ``offset`` up to ``RANKED`` Spark ranks that many rows and the page in one
    task. The place of a deeper page is sought first, by jobs that run when this is
    called: see ``sought``. To walk a whole table use ``page_after``."""
    require(df, as_list(order_by))
    order = total_order(df, order_by)
    if offset > RANKED:
        df, offset = sought(df, [*as_list(order_by), *sortable(df, as_list(order_by))], limit, offset)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def sought(df: DataFrame, columns: list[str], limit: int, offset: int) -> tuple[DataFrame, int]:
    """Rows that hold the page, and its offset among them. Values from a sample cut the
    first column into ranges, one aggregate counts them, and from the running sums
    only the ranges that the page touches are kept, by a filter that reaches the scan;
    these are cut again. Where one value is all that is left, the next column goes on,
    so a hot key is no exception. What is left to rank are ``RANKED`` rows or, where
    nothing tells rows apart (copies of one row, texts that begin alike), more."""
    n = df.count()
    for c in columns:
        kind, cell = df.schema[c].dataType, F.col(f"`{c}`")
        if not isinstance(kind, T.AtomicType):
            break
        while offset > RANKED:
            text = cell.cast("string")
            text = F.substring(text, 1, PREFIX) if isinstance(kind, T.StringType) else text
            sample = df.where(cell.isNotNull()).sample(min(1.0, 20 * RANGES / max(1, n)), seed=1)
            seen = [r[0] for r in sample.select(cell.alias("c"), text.alias("t")).groupBy("t").agg(
                F.min("c").alias("c")).orderBy("c").select("t").collect()]  # about 20 * RANGES short texts
            step = -(-len(seen) // RANGES) or 1
            cuts = [F.lit(t).cast(kind) for t in seen[::step]]
            at = F.when(cell.isNull(), F.lit(len(cuts) + 1)).otherwise(
                F.size(F.filter(F.array(*cuts), lambda x: x <= cell)) if cuts else F.lit(0))
            counts = df.groupBy(at.alias("at")).agg(
                F.count(F.lit(1)).alias("n"), F.min(cell).eqNullSafe(F.max(cell)).alias("one")).orderBy("at").collect()
            first = last = None
            before = total = 0
            for r in counts:  # at most RANGES + 2
                if total + r["n"] > offset and first is None:
                    first, before = r["at"], total
                if first is not None and total < offset + limit:
                    last, one = r["at"], r["one"]
                total += r["n"]
            if first is None:
                return df.limit(0), 0  # behind the last row
            kept = sum(r["n"] for r in counts if first <= r["at"] <= last)
            if kept == n and not (first == last and one):
                return df, offset  # nothing was told apart
            some = cell.isNotNull() if first <= len(cuts) else F.lit(False)
            if 0 < first <= len(cuts):
                some = some & (cell >= cuts[first - 1])
            if last < len(cuts):
                some = some & (cell < cuts[last])
            if last == len(cuts) + 1:
                some = some | cell.isNull()
            df, offset, n = df.where(some), offset - before, kept
            if first == last and one:
                break
    return df, offset


def page_after(df: DataFrame, key: str | list[str], limit: int,
               after: object | None = None) -> DataFrame:
    """The rows that follow the key ``after`` (a tuple for several columns; absent:
    from the start), in order of the key, missing values last: ``limit`` of them and
    all that share the last one's key, so that the next page can go on from it. The
    filter reaches the scan, so the cost does not grow with the depth of the page."""
    keys = as_list(key)
    require(df, keys)
    rows = df
    if after is not None:
        values = list(after) if isinstance(after, (tuple, list)) else [after]
        if len(values) != len(keys):
            raise ValueError(f"after needs {len(keys)} values, got {len(values)}")
        later, equal = F.lit(False), F.lit(True)
        for c, v in zip(map(F.col, keys), values):
            if v is not None:  # nothing follows a missing value
                later = later | (equal & ((c > F.lit(v)) | c.isNull()))
            equal = equal & (c.isNull() if v is None else c == F.lit(v))
        rows = df.where(later)
    # The key of the last row first, from the keys alone; the rows then stay where they
    # are until the sort, so that many rows of one key are spread over the tasks.
    place = position(keys, ascending=True)
    last = rows.select(*keys).orderBy(*sort_keys(keys)).limit(limit).agg(F.max(place)).scalar()
    return rows.where(place <= last).orderBy(*total_order(df, keys))
