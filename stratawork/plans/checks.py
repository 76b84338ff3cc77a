"""Data-quality rules and chart tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts, quality
from ..operators.quality import Expectation
from .registry import Tables, exact, in_cents, query, register

# -- one rule each ----------------------------------------------------------


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice",
        F.expr("nullif(l_returnflag, 'N')").alias("flag"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN l_tax END").alias("tax"))


_LINES = """(SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice,
    nullif(l_returnflag, 'N') AS flag, CASE WHEN l_linestatus = 'O' THEN l_tax END AS tax
    FROM lineitem)"""


def _people(t: Tables) -> DataFrame:
    """Fiscal codes built from the customer table, some of them wrong."""
    born = t.customer.select(
        "c_custkey", "c_mktsegment",
        F.expr("date_add(DATE '1950-01-01', CAST(c_acctbal AS INT) + 2000)").alias("born"),
        F.expr("CASE WHEN c_nationkey < 12 THEN 'F' ELSE 'M' END").alias("gender"))
    return born.select("c_custkey", "born", "gender", F.expr("""
        concat('RSSMRA', date_format(born, 'yy'), substr('ABCDEHLMPRST', month(born), 1),
            lpad(CAST(day(born) + CASE WHEN gender = 'F' THEN 40 ELSE 0 END
                 + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS STRING), 2, '0'),
            'H501X')""").alias("code"))


_PEOPLE = """(SELECT *, month(born) AS m, day(born) AS d FROM (
    SELECT c_mktsegment, DATE '1950-01-01' + (CAST(trunc(c_acctbal) AS INTEGER) + 2000) AS born
    FROM customer))"""

_DATASETS: dict[str, Callable[[Tables], DataFrame]] = {
    "lines": _lines, "people": _people, "orders": lambda t: t.orders,
    "customers": lambda t: t.customer}


def _run(t: Tables, use: Expectation, names: list[str], rules: dict | None = None) -> DataFrame:
    data = {n: _DATASETS[n](t) for n in names}
    return quality.run_suite([use], data, rules).select(
        "rule_id", "score", "success", "total", "failed", "error")


def _row_sql(rule: str, source: str, passes: str, tolerance: float = 1.0) -> str:
    return f"""
        SELECT '{rule}' AS rule_id, round(p / n, 4) AS score, p / n >= {tolerance} AS success,
               n AS total, n - p AS failed, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT count(*) AS n, count(*) FILTER (coalesce({passes}, FALSE)) AS p
              FROM {source})"""


def _unique_sql(rule: str, keys: str) -> str:
    return f"""
        SELECT '{rule}' AS rule_id, round(d / n, 4) AS score, d = n AS success,
               CAST(n AS BIGINT) AS total, CAST(n - d AS BIGINT) AS failed,
               CAST(NULL AS VARCHAR) AS error
        FROM (SELECT count(*) AS d, sum(c) AS n
              FROM (SELECT count(*) AS c FROM {_LINES} GROUP BY {keys}))"""


def _scalar_sql(rule: str, source: str, passes: str) -> str:
    return f"""
        SELECT '{rule}' AS rule_id, CAST({passes} AS DOUBLE) AS score, {passes} AS success,
               count(*) AS total, CAST(NULL AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS error
        FROM {source}"""


_CUSTOM = {
    "discounted": quality.custom_rule("row", ["price", "off"], "{price} * (1 - {off}) > {least}",
                                      ["least"]),
    "spread": quality.custom_rule("aggregate", ["x"],
                                  lambda x, most: F.max(x) - F.min(x) <= most, ["most"]),
}

_RULES: list[tuple[str, Expectation, list[str], str]] = [
    ("dq_not_null", Expectation("not_null", {"x": "lines.flag"}, tolerance=0.4), ["lines"],
     _row_sql("not_null", _LINES, "flag IS NOT NULL", 0.4)),
    ("dq_between", Expectation("between", {"x": "lines.tax"}, {"min_val": 0.01, "max_val": 0.06}),
     ["lines"], _row_sql("between", _LINES, "tax BETWEEN 0.01 AND 0.06")),
    ("dq_in_set", Expectation("in_set", {"x": "lines.flag"}, {"allowed_values": ["A", "X"]}),
     ["lines"], _row_sql("in_set", _LINES, "flag IN ('A', 'X')")),
    ("dq_regex", Expectation("regex", {"x": "orders.o_orderpriority"}, {"pattern": "^[1-3]-.*[HM]"}),
     ["orders"], _row_sql("regex", "orders", "regexp_matches(o_orderpriority, '^[1-3]-.*[HM]')")),
    ("dq_type", Expectation("type", {"x": "lines.flag"}, {"target_type": "str"}), ["lines"],
     _row_sql("type", _LINES, "flag IS NOT NULL")),
    ("dq_length", Expectation("length", {"x": "orders.o_orderpriority"},
                              {"min_len": 5, "max_len": 8}), ["orders"],
     _row_sql("length", "orders", "length(o_orderpriority) BETWEEN 5 AND 8")),
    ("dq_pair_greater", Expectation("pair_greater", {"a": "lines.tax", "b": "lines.l_discount"}),
     ["lines"], _row_sql("pair_greater", _LINES, "tax > l_discount")),
    ("dq_mean", Expectation("mean", {"x": "lines.l_quantity"}, {"min_avg": 20, "max_avg": 30}),
     ["lines"], _scalar_sql("mean", _LINES, "avg(l_quantity) BETWEEN 20 AND 30")),
    ("dq_unique", Expectation("unique", {"x": "lines.tax"}), ["lines"],
     _unique_sql("unique", "tax")),
    ("dq_compound_unique", Expectation("compound_unique", {"a": "lines.l_orderkey",
                                                           "b": "lines.l_linenumber"}), ["lines"],
     _unique_sql("compound_unique", "l_orderkey, l_linenumber")),
    ("dq_in_other", Expectation("in_other", {"x": "orders.o_custkey", "y": "customers.c_custkey"}),
     ["orders", "customers"],
     _row_sql("in_other", "orders", "o_custkey IN (SELECT c_custkey FROM customer)")),
    ("dq_fiscal_code", Expectation("fiscal_code", {
        "fiscalcode": "people.code", "birthdate": "people.born", "gender": "people.gender"}),
     ["people"], _row_sql("fiscal_code", _PEOPLE, "c_mktsegment <> 'BUILDING'")),
    ("dq_custom_row", Expectation("discounted", {"price": "lines.l_extendedprice",
                                                 "off": "lines.l_discount"}, {"least": 20000}),
     ["lines"], _row_sql("discounted", _LINES, "l_extendedprice * (1 - l_discount) > 20000")),
    ("dq_custom_agg", Expectation("spread", {"x": "lines.l_quantity"}, {"most": 49}), ["lines"],
     _scalar_sql("spread", _LINES, "max(l_quantity) - min(l_quantity) <= 49")),
]

for _name, _use, _names, _sql in _RULES:
    register(_name, lambda t, u=_use, n=_names: _run(t, u, n, _CUSTOM), _sql)

# -- suites and failing rows ------------------------------------------------

SUITE = [
    Expectation("not_null", {"x": "lines.l_orderkey"}),
    Expectation("between", {"x": "lines.l_quantity"}, {"min_val": 1, "max_val": 50}),
    Expectation("in_set", {"x": "lines.flag"}, {"allowed_values": ["A", "R"]}, 0.5),
    Expectation("mean", {"x": "lines.l_discount"}, {"min_avg": 0.0, "max_avg": 0.2}),
    Expectation("compound_unique", {"a": "lines.l_orderkey", "b": "lines.l_linenumber"}),
    Expectation("in_other", {"x": "lines.l_orderkey", "y": "orders.o_orderkey"}),
    Expectation("not_null", {"x": "lines.no_such_column"}),
    Expectation("no_such_rule", {"x": "lines.l_orderkey"}),
]


def _suite(t: Tables) -> DataFrame:
    return quality.run_suite(SUITE, {"lines": _lines(t), "orders": t.orders})


_SUITE_SQL = f"""(
    SELECT 0 AS position, 'not_null' AS rule_id, avg(CASE WHEN l_orderkey IS NOT NULL THEN 1.0
        ELSE 0 END) AS score, 1.0 AS tolerance FROM lineitem
    UNION ALL SELECT 1, 'between', avg(CASE WHEN l_quantity BETWEEN 1 AND 50 THEN 1.0 ELSE 0 END),
        1.0 FROM lineitem
    UNION ALL SELECT 2, 'in_set', avg(CASE WHEN flag IN ('A', 'R') THEN 1.0 ELSE 0 END), 0.5
        FROM {_LINES}
    UNION ALL SELECT 3, 'mean', CASE WHEN avg(l_discount) BETWEEN 0 AND 0.2 THEN 1.0 ELSE 0 END, 1.0
        FROM lineitem
    UNION ALL SELECT 4, 'compound_unique', count(*) / sum(c), 1.0
        FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 5, 'in_other', avg(CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders)
        THEN 1.0 ELSE 0 END), 1.0 FROM lineitem
    UNION ALL SELECT 6, 'not_null', NULL, 1.0
    UNION ALL SELECT 7, 'no_such_rule', NULL, 1.0)"""


@query(f"""
    SELECT CAST(position AS INTEGER) AS position, rule_id, CAST(round(score, 4) AS DOUBLE) AS score,
           coalesce(score >= tolerance, FALSE) AS success FROM {_SUITE_SQL}
""")
def dq_suite(t: Tables) -> DataFrame:
    return _suite(t).select("position", "rule_id", "score", "success")


@query(f"""
    SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed,
           round(count(*) FILTER (ok) / count(*), 4) AS score, bool_and(ok) AS success
    FROM (SELECT coalesce(score >= tolerance, FALSE) AS ok FROM {_SUITE_SQL})
""")
def dq_suite_summary(t: Tables) -> DataFrame:
    return quality.summarize(_suite(t))


_NAN = "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 4 THEN NULL " \
       "ELSE l_quantity END"


@query("""
    SELECT rule_id, CAST(round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 4) AS DOUBLE) AS score,
           count(*) FILTER (NOT ok) AS failed FROM (
        SELECT 'not_null' AS rule_id, l_linenumber NOT IN (3, 4) AS ok FROM lineitem
        UNION ALL
        SELECT 'between', l_linenumber NOT IN (3, 4) AND l_quantity <= 30 FROM lineitem)
    GROUP BY rule_id
""")
def dq_not_null_nan(t: Tables) -> DataFrame:
    """NaN is missing, as null is."""
    rows = t.lineitem.select(F.expr(_NAN).alias("q"))
    return quality.run_suite([
        Expectation("not_null", {"x": "lines.q"}),
        Expectation("between", {"x": "lines.q"}, {"min_val": 0, "max_val": 30})], {"lines": rows}).select(
        "rule_id", "score", "failed")


@query("""
    SELECT 'not_null' AS rule_id, CAST(1 AS DOUBLE) AS score, count(*) > 0 AS success, FALSE AS broken
    FROM lineitem
    UNION ALL SELECT 'whole', NULL, FALSE, TRUE
    UNION ALL SELECT 'between', CAST(round(avg(CASE WHEN l_quantity <= 30 THEN 1.0 ELSE 0 END), 4) AS DOUBLE),
        FALSE, FALSE FROM lineitem
""")
def dq_suite_failing_rule(t: Tables) -> DataFrame:
    """A rule whose cast fails on the data is one failed row; the others stand."""
    rules = {"whole": quality.custom_rule("row", ["x"], "cast({x} AS int) > 0")}
    uses = [Expectation("not_null", {"x": "lines.l_orderkey"}),
            Expectation("whole", {"x": "lines.l_returnflag"}),
            Expectation("between", {"x": "lines.l_quantity"}, {"min_val": 0, "max_val": 30})]
    return quality.score_suite(uses, {"lines": t.lineitem}, rules).select(
        "rule_id", "score", "success", F.col("error").isNotNull().alias("broken"))


@query(f"SELECT *, 'between' AS rule_id FROM {_LINES} "
       "WHERE NOT coalesce(tax BETWEEN 0.01 AND 0.06, FALSE)")
def dq_failed_rows(t: Tables) -> DataFrame:
    use = Expectation("between", {"x": "lines.tax"}, {"min_val": 0.01, "max_val": 0.06})
    return quality.failed_rows(use, {"lines": _lines(t)})


@query("""
    SELECT l_orderkey, l_linenumber, 'compound_unique' AS rule_id FROM (
        SELECT l_orderkey, l_linenumber,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS r FROM lineitem)
    WHERE r > 1
""")
def dq_failed_rows_unique(t: Tables) -> DataFrame:
    use = Expectation("compound_unique", {"a": "lines.l_orderkey", "b": "lines.l_linenumber"})
    return quality.failed_rows(use, {"lines": t.lineitem.select("l_orderkey", "l_linenumber")})


@query(f"""
    SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN flag IS NULL THEN '0' END,
        CASE WHEN NOT coalesce(tax BETWEEN 0.01 AND 0.06, FALSE) THEN '1' END,
        CASE WHEN r > 1 THEN '2' END, CASE WHEN l_orderkey NOT IN (
            SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') THEN '3' END) AS failed
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_quantity, l_discount, l_extendedprice, flag NULLS LAST, tax NULLS LAST) AS r FROM {_LINES})
    WHERE failed <> ''
""")
def dq_failing_rows(t: Tables) -> DataFrame:
    """The rows that fail any rule of a suite, with all the rules they fail."""
    uses = [Expectation("not_null", {"x": "lines.flag"}),
            Expectation("between", {"x": "lines.tax"}, {"min_val": 0.01, "max_val": 0.06}),
            Expectation("compound_unique", {"a": "lines.l_orderkey", "b": "lines.l_linenumber"}),
            Expectation("in_other", {"x": "lines.l_orderkey", "y": "open.o_orderkey"})]
    out = quality.failing_rows(uses, {"lines": _lines(t), "open": t.orders.where("o_orderstatus <> 'F'")},
                               order_by="l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.col("failed").cast("array<string>")).alias("failed"))


# -- charts -----------------------------------------------------------------

_MONEY = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"""
    SELECT o_orderpriority, {_MONEY} AS value FROM orders GROUP BY o_orderpriority
    ORDER BY o_orderpriority DESC LIMIT 4
""")
def chart_xy(t: Tables) -> DataFrame:
    return charts.chart_xy(exact(t.orders, "o_totalprice"), "o_orderpriority", "o_totalprice",
                           sort="desc", limit=4)


@query("SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS value FROM lineitem "
       "GROUP BY l_linenumber")
def chart_xy_count(t: Tables) -> DataFrame:
    return charts.chart_xy(t.lineitem, "l_linenumber", agg="count")


@query(f"""
    SELECT month_name, {_MONEY} AS value
    FROM (SELECT strftime(o_orderdate, '%b') AS month_name, month(o_orderdate) AS m, o_totalprice
          FROM orders) GROUP BY month_name, m ORDER BY m LIMIT 6
""")
def chart_xy_sort_field(t: Tables) -> DataFrame:
    rows = exact(t.orders, "o_totalprice").select(
        F.date_format("o_orderdate", "MMM").alias("month_name"),
        F.month("o_orderdate").alias("m"), "o_totalprice")
    return charts.chart_xy(rows, "month_name", "o_totalprice", sort_field="m", limit=6)


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, "
       + ", ".join(f"""coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
           FILTER (o_orderstatus = '{s}') AS DOUBLE), 0) AS "{s}" """ for s in "FOP")
       + "FROM orders GROUP BY year(o_orderdate)")
def chart_xy_color(t: Tables) -> DataFrame:
    rows = exact(t.orders, "o_totalprice").withColumn("year", F.year("o_orderdate"))
    return charts.chart_xy_color(rows, "year", "o_orderstatus", "o_totalprice", sort="asc",
                                 colors=["F", "O", "P"])


@query("""
    SELECT name, value, round(value / sum(value) OVER (), 6) AS share FROM (
        SELECT c_mktsegment AS name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM customer GROUP BY c_mktsegment)
""")
def chart_pie(t: Tables) -> DataFrame:
    return charts.chart_pie(exact(t.customer, "c_acctbal"), "c_mktsegment", "c_acctbal")


@query("""
    SELECT name, value, share FROM (
        SELECT name, value, round(value / sum(value) OVER (), 6) AS share FROM (
            SELECT CAST(c_nationkey AS VARCHAR) AS name,
                   CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value
            FROM customer GROUP BY c_nationkey))
    ORDER BY name LIMIT 7
""")
def chart_pie_first(t: Tables) -> DataFrame:
    """Seven slices with their shares of all 25."""
    return charts.chart_pie(exact(t.customer, "c_acctbal"), "c_nationkey", "c_acctbal", limit=7)


@query("""
    WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 12 AS w
               FROM events),
    e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 WHEN i = 12 THEN hi
                    ELSE lo + i * w END AS edge
          FROM r, (SELECT unnest(range(0, 13)) AS i))
    SELECT CAST(b.i AS INTEGER) AS bin, a.edge AS lower, b.edge AS upper, count(v.value) AS n
    FROM e b JOIN e a ON a.i = b.i - 1
    LEFT JOIN events v ON v.value > a.edge AND v.value <= b.edge
    GROUP BY b.i, a.edge, b.edge
""")
def chart_histogram(t: Tables) -> DataFrame:
    return charts.chart_histogram(t.events, "value", 12)


@query("""
    SELECT l_quantity, l_extendedprice FROM lineitem
    ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
             l_extendedprice LIMIT 200
""")
def chart_scatter(t: Tables) -> DataFrame:
    return charts.chart_scatter(t.lineitem, "l_quantity", "l_extendedprice",
                                ["l_shipdate", "l_orderkey"], limit=200)


@query("""
    WITH w AS (
        SELECT l_returnflag AS name, avg(CAST(round(l_quantity) AS BIGINT)) AS quantity,
               avg(CAST(round(l_discount * 100) AS BIGINT)) AS discount,
               avg(CAST(round(l_tax * 100) AS BIGINT)) AS tax
        FROM lineitem GROUP BY l_returnflag)
    SELECT name, axis, round(v, 6) AS value, round(max(v) OVER (PARTITION BY axis), 6) * 1.2
        AS axis_max
    FROM (SELECT name, 'quantity' AS axis, quantity AS v FROM w
          UNION ALL SELECT name, 'discount', discount FROM w
          UNION ALL SELECT name, 'tax', tax FROM w)
""")
def chart_radar(t: Tables) -> DataFrame:
    rows = in_cents(t.lineitem, "l_discount", "l_tax").select(
        "l_returnflag", F.round("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return charts.chart_radar(rows, ["quantity", "discount", "tax"], "l_returnflag", "mean")


@query(f"""
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, {_MONEY} AS o_totalprice_sum,
           CAST(count(*) AS DOUBLE) AS o_orderkey_count, max(o_totalprice) AS o_totalprice_max
    FROM orders GROUP BY year(o_orderdate) ORDER BY 1 DESC LIMIT 5
""")
def chart_combo(t: Tables) -> DataFrame:
    rows = exact(t.orders, "o_totalprice").withColumn("year", F.year("o_orderdate"))
    return charts.chart_combo(rows, "year", [("o_totalprice", "sum"), ("o_orderkey", "count"),
                                             ("o_totalprice", "max")], sort="desc", limit=5)
