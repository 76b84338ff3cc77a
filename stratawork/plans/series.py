"""First/last/duplicate rows, incremental tables and regular time series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import custom, gaps, groups, incremental
from .registry import Tables, as_double, day_text, exact, query, register, time_text

# -- first, last, duplicates ------------------------------------------------


def _events(t: Tables) -> DataFrame:
    """Events with some missing types, the time as text."""
    return t.events.select("user_id", time_text("ts").alias("seen"), "event_id",
                           F.expr("nullif(event_type, 'error')").alias("kind"),
                           F.expr("CASE WHEN value > 5 THEN value END").alias("value"))


_EVENTS = """(SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen, event_id,
    nullif(event_type, 'error') AS kind, CASE WHEN value > 5 THEN value END AS value
    FROM events)"""


def _per_group_sql(pick: str) -> str:
    return f"""
        SELECT user_id, {pick}(seen, seen) AS seen, {pick}(event_id, seen) AS event_id,
               {pick}(kind, seen) FILTER (kind IS NOT NULL) AS kind,
               {pick}(value, seen) FILTER (value IS NOT NULL) AS value
        FROM {_EVENTS} GROUP BY user_id"""


@query(_per_group_sql("arg_max"))
def last_per_group(t: Tables) -> DataFrame:
    return groups.last_per_group(_events(t), "user_id", "seen")


@query(_per_group_sql("arg_min"))
def first_per_group(t: Tables) -> DataFrame:
    return groups.first_per_group(_events(t), "user_id", "seen")


@query(_per_group_sql("arg_min"))
def last_per_group_descending(t: Tables) -> DataFrame:
    return groups.last_per_group(_events(t), "user_id", "seen", ascending=False)


@query(f"""
    SELECT user_id, seen, event_id, kind, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS r FROM {_EVENTS})
    WHERE r = 1
""")
def last_row_per_group(t: Tables) -> DataFrame:
    return groups.last_per_group(_events(t), "user_id", "seen", whole_row=True)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LINE_SQL = ", ".join(_LINE)


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*_LINE, day_text("l_shipdate").alias("shipped"))


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in
                      ["shipped", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return f"""
        SELECT {_LINE_SQL}, shipped FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) r
            FROM (SELECT {_LINE_SQL}, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem))
        WHERE r = 1"""


@query(_dedup_sql("ASC"))
def dedup_first(t: Tables) -> DataFrame:
    return groups.deduplicate(_lines(t), ["l_orderkey", "l_linenumber"], "first", "shipped")


@query(_dedup_sql("DESC"))
def dedup_last(t: Tables) -> DataFrame:
    return groups.deduplicate(_lines(t), ["l_orderkey", "l_linenumber"], "last", "shipped")


@query(f"""
    SELECT {_LINE_SQL}, shipped FROM (
        SELECT {_LINE_SQL}, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
               count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
    WHERE n = 1
""")
def dedup_none(t: Tables) -> DataFrame:
    return groups.deduplicate(_lines(t), ["l_orderkey", "l_linenumber"], False)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_all_columns(t: Tables) -> DataFrame:
    return groups.deduplicate(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(f"""
    SELECT {_LINE_SQL}, shipped, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY shipped, l_partkey, l_suppkey, l_quantity, l_extendedprice) > 1 AS is_duplicate
    FROM (SELECT {_LINE_SQL}, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem)
""")
def duplicated_flag(t: Tables) -> DataFrame:
    return groups.flag_duplicates(_lines(t), ["l_orderkey", "l_linenumber"], "shipped")


# -- incremental tables -----------------------------------------------------

_TODAY = "2024-01-20"
_DATED_SQL = "SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS date " \
             "FROM events"


def _dated(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value",
                           day_text("ts").alias("date"))


@query(f"""
    SELECT * FROM ({_DATED_SQL}) WHERE date <> '{_TODAY}'
    UNION ALL
    SELECT event_id, user_id, event_type, value * 2, '{_TODAY}'
    FROM ({_DATED_SQL}) WHERE date = '{_TODAY}' AND event_type <> 'error'
""")
def accumulate(t: Tables) -> DataFrame:
    """A day delivered again without its errors and with new values."""
    history = _dated(t)
    today = history.where(f"date = '{_TODAY}' AND event_type <> 'error'") \
        .withColumn("value", F.col("value") * 2).drop("date")
    return incremental.accumulate(history, today, "date", _TODAY)


@query(f"""
    SELECT user_id, event_type, min(date) AS date FROM ({_DATED_SQL}) GROUP BY user_id, event_type
    UNION ALL
    SELECT DISTINCT user_id, 'seen', '{_TODAY}' FROM ({_DATED_SQL}) WHERE date = '{_TODAY}'
""")
def accumulate_dedup(t: Tables) -> DataFrame:
    history = _dated(t).select("user_id", "event_type", "date")
    today = history.where(f"date = '{_TODAY}'")
    again = today.unionByName(today.withColumn("event_type", F.lit("seen")))
    return incremental.accumulate_dedup(history, again, "date", _TODAY)


@query("""
    WITH today AS (
        SELECT custkey, name, balance FROM (
            SELECT o_custkey AS custkey, 'order ' || o_orderkey AS name, o_totalprice AS balance,
                   row_number() OVER (PARTITION BY o_custkey
                       ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
            FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')
        WHERE r = 1)
    SELECT * FROM today
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT custkey FROM today)
""")
def upsert(t: Tables) -> DataFrame:
    previous = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"),
                                 F.col("c_acctbal").alias("balance"), F.lit(None).alias("d"),
                                 F.lit(None).alias("k"))
    today = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select(
        F.col("o_custkey").alias("custkey"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"),
        F.col("o_totalprice").alias("balance"), F.col("o_orderdate").alias("d"),
        F.col("o_orderkey").alias("k"))
    return incremental.upsert(previous, today, "custkey", ["d", "k"]).drop("d", "k")


# -- regular series ---------------------------------------------------------


def _daily(t: Tables) -> DataFrame:
    daily = exact(t.events, "value").groupBy("user_id", day_text("ts").alias("date")).agg(
        F.sum("value").alias("total"), F.max("event_type").alias("kind"))
    return as_double(daily, "total")


_DAILY = """(SELECT user_id, CAST(ts AS DATE) AS d,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(event_type) AS kind
    FROM events GROUP BY ALL)"""

_GRID = f"""(SELECT g.user_id, g.d, s.total, s.kind,
    row_number() OVER (PARTITION BY g.user_id ORDER BY g.d) AS p
    FROM (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
          FROM (SELECT DISTINCT user_id FROM events),
               (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)) g
    LEFT JOIN {_DAILY} s ON s.user_id = g.user_id AND s.d = g.d)"""

_BACK = "OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AHEAD = "OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

_FILLS = {
    "null": ("total", "kind"),
    "zero": ("coalesce(total, 0)", "coalesce(kind, '')"),
    "ffill": (f"last_value(total IGNORE NULLS) {_BACK}", f"last_value(kind IGNORE NULLS) {_BACK}"),
    "bfill": (f"first_value(total IGNORE NULLS) {_AHEAD}",
              f"first_value(kind IGNORE NULLS) {_AHEAD}"),
}

for _strategy, (_total, _kind) in _FILLS.items():
    register(f"reindex_day_{_strategy}",
             lambda t, s=_strategy: gaps.reindex_series(_daily(t), "date", "user_id", fill=s),
             f"SELECT user_id, strftime(d, '%Y-%m-%d') AS date, {_total} AS total, "
             f"{_kind} AS kind FROM {_GRID}")


@query(f"""
    SELECT user_id, strftime(d, '%Y-%m-%d') AS date, kind,
           round(CASE WHEN total IS NOT NULL THEN total WHEN v0 IS NULL THEN v1
                      WHEN v1 IS NULL THEN v0
                      ELSE v0 + (v1 - v0) / (p1 - p0) * (p - p0) END, 6) AS total
    FROM (SELECT *, last_value(total IGNORE NULLS) {_BACK} AS v0,
                 first_value(total IGNORE NULLS) {_AHEAD} AS v1,
                 last_value(CASE WHEN total IS NOT NULL THEN p END IGNORE NULLS) {_BACK} AS p0,
                 first_value(CASE WHEN total IS NOT NULL THEN p END IGNORE NULLS) {_AHEAD} AS p1
          FROM {_GRID})
""")
def reindex_day_interpolate(t: Tables) -> DataFrame:
    out = gaps.reindex_series(_daily(t), "date", "user_id",
                              fill={"strategy": "null", "columns": {"total": "interpolate"}})
    return out.withColumn("total", F.round("total", 6))


@query(f"""
    SELECT user_id, strftime(d, '%Y-%m-%d') AS date, coalesce(total, 0) AS total,
           last_value(kind IGNORE NULLS) {_BACK} AS kind
    FROM {_GRID}
""")
def reindex_day_mixed(t: Tables) -> DataFrame:
    """A strategy of its own for one column, a default for the rest."""
    return gaps.reindex_series(_daily(t), "date", "user_id",
                               fill={"strategy": "ffill", "columns": {"total": "zero"}})


@query("""
    SELECT g.user_id, strftime(g.d, '%Y-%m-%d') AS date, e.event_id, e.value
    FROM (SELECT user_id, CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02',
                                                      INTERVAL 1 DAY)) AS DATE) AS d
          FROM (SELECT DISTINCT user_id FROM events)) g
    LEFT JOIN events e ON e.user_id = g.user_id AND CAST(e.ts AS DATE) = g.d
""")
def reindex_keeps_rows(t: Tables) -> DataFrame:
    """Several rows per day stay; bounds given."""
    rows = t.events.select("user_id", F.col("ts").alias("date"), "event_id", "value")
    return gaps.reindex_series(rows, "date", "user_id", start="2023-12-30", end="2024-02-02")


@query("""
    WITH s AS (
        SELECT o_custkey, date_trunc('month', o_orderdate) AS d,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders GROUP BY ALL),
    g AS (
        SELECT o_custkey, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS d
        FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT min(d) AS lo, max(d) AS hi FROM s))
    SELECT g.o_custkey, strftime(g.d, '%Y-%m') AS month,
           last_value(total IGNORE NULLS) OVER (PARTITION BY g.o_custkey ORDER BY g.d
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM g LEFT JOIN s ON s.o_custkey = g.o_custkey AND s.d = g.d
""")
def reindex_month(t: Tables) -> DataFrame:
    monthly = exact(t.orders, "o_totalprice").groupBy(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum("o_totalprice").cast("double").alias("total"))
    return gaps.reindex_series(monthly, "month", "o_custkey", "month", fill="ffill")


@query("""
    WITH s AS (
        SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS d, count(*) AS n
        FROM events WHERE event_type = 'purchase' GROUP BY ALL),
    g AS (
        SELECT user_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-29',
                                                    INTERVAL 7 DAYS)) AS DATE) AS d
        FROM (SELECT DISTINCT user_id FROM s))
    SELECT g.user_id, strftime(g.d, '%Y-%m-%d') AS week, coalesce(n, 0) AS n
    FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.d = g.d
""")
def reindex_week(t: Tables) -> DataFrame:
    weekly = t.events.where("event_type = 'purchase'").groupBy(
        "user_id", F.date_trunc("week", "ts").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n"))
    return gaps.reindex_series(weekly, "week", "user_id", "week", start="2023-12-28",
                               end="2024-01-31", fill="zero")


@query("""
    WITH s AS (
        SELECT o_custkey, date_trunc('year', o_orderdate) AS d, count(*) AS n
        FROM orders GROUP BY ALL),
    g AS (
        SELECT o_custkey, unnest(generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '2001-01-01',
                                                 INTERVAL 1 YEAR)) AS d
        FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT g.o_custkey, strftime(g.d, '%Y') AS year,
           first_value(n IGNORE NULLS) OVER (PARTITION BY g.o_custkey ORDER BY g.d
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
    FROM g LEFT JOIN s ON s.o_custkey = g.o_custkey AND s.d = g.d
""")
def reindex_year(t: Tables) -> DataFrame:
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"))
    return gaps.reindex_series(yearly, "year", "o_custkey", "year", start="1993", fill="bfill")


@query("""
    WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders
               WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
    g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM s)
    SELECT strftime(g.d, '%Y-%m-%d') AS date,
           last_value(n IGNORE NULLS) OVER (ORDER BY g.d
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
    FROM g LEFT JOIN s ON s.d = g.d
""")
def reindex_ungrouped(t: Tables) -> DataFrame:
    daily = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(
        F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return gaps.reindex_series(daily, fill="ffill")


# -- user code --------------------------------------------------------------


@query("""
    SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey
""")
def transform(t: Tables) -> DataFrame:
    def spend(df: DataFrame, status: str) -> DataFrame:
        rows = exact(df, "o_totalprice").where(F.col("o_orderstatus") == status)
        return rows.groupBy("o_custkey").agg(F.sum("o_totalprice").cast("double").alias("total"))
    return custom.transform(t.orders, spend, status="O")


@query("SELECT part.p_partkey, upper(p_name) AS label, p_size * p_size AS area FROM part")
def transform_batches(t: Tables) -> DataFrame:
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_partkey": batch["p_partkey"], "label": batch["p_name"].str.upper(),
                             "area": batch["p_size"] * batch["p_size"]})
    rows = t.part.select("p_partkey", "p_name", "p_size")
    return custom.transform_batches(rows, fn, "p_partkey bigint, label string, area int")


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders,
           strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
           strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
           CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS INTEGER) AS days
    FROM orders GROUP BY year(o_orderdate)
""")
def transform_grouped(t: Tables) -> DataFrame:
    """Per year in pandas, in a form that merges: counts add up, dates keep
    their extremes."""
    rows = t.orders.select(F.year("o_orderdate").alias("year"), F.lit(1).cast("bigint").alias("n"),
                           day_text("o_orderdate").alias("lo"), day_text("o_orderdate").alias("hi"))

    def partial(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"year": [g["year"].iloc[0]], "n": [g["n"].sum()],
                             "lo": [g["lo"].min()], "hi": [g["hi"].max()]})

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        one = partial(g)
        days = (pd.to_datetime(one["hi"]) - pd.to_datetime(one["lo"])).dt.days + 1
        return pd.DataFrame({"year": one["year"], "orders": one["n"], "first_day": one["lo"],
                             "last_day": one["hi"], "days": days})
    return custom.transform_grouped(
        rows, "year", partial, "year int, n bigint, lo string, hi string", finish,
        "year int, orders bigint, first_day string, last_day string, days int")
