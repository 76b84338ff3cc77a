"""Projections, joins, aggregates, pivots, sorts and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, scalars
from ..operators import aggregates, gaps, joins, pivots, project, ranking, sets
from ..sources import files
from .registry import Tables, as_double, day_text, exact, in_cents, query, register

# -- projections and filters ------------------------------------------------


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem
    WHERE l_quantity > 30 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R')
""")
def filter(t: Tables) -> DataFrame:  # noqa: A001
    rows = project.filter_rows(
        t.lineitem, "l_quantity > 30 and l_discount >= 0.05 and l_returnflag in ('A', 'R')")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


@query("""
    SELECT l_orderkey, l_linenumber, flag, qty FROM (
        SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag,
               CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity END AS qty FROM lineitem)
    WHERE flag IS DISTINCT FROM 'A' AND NOT coalesce(qty > 25, FALSE)
""")
def filter_null_mode(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'N')").alias("flag"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity END").alias("qty"))
    return project.filter_rows(rows, nulls.ne("flag", "A") & ~nulls.gt("qty", 25))


@query("SELECT l_shipmode_stand_in, l_orderkey FROM "
       "(SELECT l_returnflag AS l_shipmode_stand_in, l_orderkey FROM lineitem)")
def select(t: Tables) -> DataFrame:
    named = t.lineitem.withColumnRenamed("l_returnflag", "l_shipmode_stand_in")
    return project.select(named, ["l_shipmode_stand_in", "l_orderkey"])


@query("""
    SELECT l_orderkey, l_linenumber, net, net * (1 + l_tax) AS gross, net / l_quantity AS unit_net
    FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
""")
def derive_expr(t: Tables) -> DataFrame:
    out = project.derive(t.lineitem, [
        {"name": "net", "expr": "l_extendedprice * (1 - l_discount)"},
        {"name": "gross", "expr": "net * (1 + l_tax)"},
        {"name": "unit_net", "expr": F.try_divide("net", "l_quantity")}])
    return out.select("l_orderkey", "l_linenumber", "net", "gross", "unit_net")


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS flag_label,
           CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' END AS line_label
    FROM lineitem
""")
def derive_mapping(t: Tables) -> DataFrame:
    out = project.derive(t.lineitem, [
        {"name": "flag_label", "source": "l_returnflag",
         "mapping": {"A": "accepted", "R": "returned"}},
        {"name": "line_label", "source": "l_linenumber",
         "mapping": {"1": "first", "2": "second"}}])
    return out.select("l_orderkey", "l_linenumber", "flag_label", "line_label")


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey <= 900 AND o_custkey % 3 <> 0 THEN o_custkey * 10 END AS o_custkey,
           CASE WHEN o_custkey <= 900 AND o_custkey % 3 <> 0 THEN o_custkey * 10 END AS label
    FROM orders
""")
def derive_mapping_long(t: Tables) -> DataFrame:
    """600 whole-number labels, in a new column and in place of their source."""
    mapping = {k: 10 * k for k in range(1, 901) if k % 3}
    out = project.derive(t.orders.select("o_orderkey", "o_custkey"), [
        {"name": "label", "source": "o_custkey", "mapping": mapping},
        {"name": "o_custkey", "source": "o_custkey", "mapping": mapping}])
    return out


@query("SELECT s_suppkey, s_name, 'supplier' AS source_label FROM supplier")
def add_constant(t: Tables) -> DataFrame:
    out = project.add_constant(t.supplier.select("s_suppkey", "s_name"),
                               "source_label", "supplier")
    return project.add_constant(out, "s_name", "kept as it is")


@query("""
    SELECT event_id, kind, big FROM (
        SELECT event_id, nullif(event_type, 'error') AS kind,
               CASE WHEN value > 20 THEN value END AS big FROM events)
    WHERE kind IS NOT NULL AND big IS NOT NULL
""")
def drop_nulls(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.expr("nullif(event_type, 'error')").alias("kind"),
                           F.expr("CASE WHEN value > 20 THEN value END").alias("big"))
    return project.drop_nulls(rows, ["kind", "big"])


@query("""
    SELECT o_orderstatus,
           CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS "1-URGENT",
           CAST(count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS BIGINT)
               AS "4-NOT_SPECIFIED"
    FROM orders GROUP BY o_orderstatus
""")
def rename_safe(t: Tables) -> DataFrame:
    wide = pivots.pivot(t.orders, "o_orderstatus", "o_orderpriority", "o_orderkey", "count",
                        column_values=["1-URGENT", "4-NOT SPECIFIED"])
    return project.rename_safe(wide)


@query("""
    SELECT p_partkey, substr(p_name, 1, 5) AS head, length(p_name) AS n_chars,
           lower(trim(p_type)) AS kind, regexp_matches(p_name, 'r.ng') AS has_ring,
           CAST(p_size // 7 AS BIGINT) AS weeks, p_size % 7 AS rest,
           least(greatest(p_size, 10), 40) AS clipped,
           round(p_retailprice / nullif(p_size - 10, 0), 4) AS per_size
    FROM part
""")
def scalar_functions(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", scalars.slice_text("p_name", 0, 5).alias("head"),
        F.length("p_name").cast("bigint").alias("n_chars"),
        scalars.strip_lower("p_type").alias("kind"),
        scalars.matches("p_name", "r.ng").alias("has_ring"),
        scalars.floor_div("p_size", 7).alias("weeks"), scalars.modulo("p_size", 7).alias("rest"),
        scalars.clip("p_size", 10, 40).alias("clipped"),
        scalars.ratio("p_retailprice", F.col("p_size") - 10, 4).alias("per_size"))


# -- joins ------------------------------------------------------------------

# Finished orders get a key no customer has, so both sides have rows alone.
_ORDER_KEY = "CASE WHEN o_orderstatus = 'F' THEN -1 - o_custkey ELSE o_custkey END"


def _join_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name",
                             F.col("c_acctbal").alias("amount"))
    right = t.orders.select(F.expr(_ORDER_KEY).alias("custkey"), "o_orderkey",
                            F.col("o_totalprice").alias("amount"))
    return left, right


def _join_sql(kind: str) -> str:
    return f"""
        SELECT coalesce(l.custkey, r.custkey) AS custkey, c_name, l.amount AS amount_x,
               o_orderkey, r.amount AS amount_y
        FROM (SELECT c_custkey AS custkey, c_name, c_acctbal AS amount FROM customer) l
        {kind} JOIN (SELECT {_ORDER_KEY} AS custkey, o_orderkey, o_totalprice AS amount
                     FROM orders) r ON l.custkey IS NOT DISTINCT FROM r.custkey
    """


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    register(f"join_{_how}",
             lambda t, how=_how: joins.join(*_join_sides(t), "custkey", how), _join_sql(_kind))


@query("""
    SELECT l.custkey, c_name, l.amount AS amount_balance, o_orderkey, r.amount AS amount
    FROM (SELECT c_custkey AS custkey, c_name, c_acctbal AS amount FROM customer) l
    JOIN (SELECT o_custkey AS custkey, o_orderkey, o_totalprice AS amount FROM orders) r
      ON l.custkey = r.custkey
""")
def join_suffix(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name",
                             F.col("c_acctbal").alias("amount"))
    right = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey",
                            F.col("o_totalprice").alias("amount"))
    return joins.join(left, right, "custkey", "inner", ("_balance", ""))


@query("""
    SELECT s.k1 AS nationkey, s_suppkey, n_name
    FROM (SELECT nullif(s_nationkey, 3) AS k1, s_suppkey FROM supplier) s
    LEFT JOIN (SELECT nullif(n_nationkey, 3) AS k2, n_name FROM nation) n
      ON s.k1 IS NOT DISTINCT FROM n.k2
""")
def join_null_safe(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(F.expr("nullif(s_nationkey, 3)").alias("nationkey"), "s_suppkey")
    nations = t.nation.select(F.expr("nullif(n_nationkey, 3)").alias("nationkey"), "n_name")
    return joins.join(suppliers, nations, "nationkey", "left")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def semi_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'") \
        .select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.semi_join(lines, urgent, "l_orderkey")


@query("""
    SELECT c_custkey, c_name, c_custkey IN (
        SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_member
    FROM customer
""")
def membership_flag(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000")
    return joins.with_membership(t.customer.select("c_custkey", "c_name"), "c_custkey",
                                 big, "o_custkey")


@query("""
    SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (
        SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)
""")
def anti_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_join(t.customer.select("c_custkey", "c_name"), big, "c_custkey")


@query("""
    SELECT user_id, strftime(d, '%Y-%m-%d') AS day
    FROM (SELECT DISTINCT user_id FROM events),
         (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)),
                                        INTERVAL 1 DAY)) AS d FROM events)
""")
def cross_join(t: Tables) -> DataFrame:
    """Groups with periods: generated per group, no join."""
    days = t.events.select("user_id", F.col("ts").cast("date").alias("d"))
    low, high = days.agg(F.min("d")).scalar(), days.agg(F.max("d")).scalar()
    grid = gaps.calendar_grid(days.select("user_id").distinct(), low, high, "day", "d")
    return grid.select("user_id", day_text("d").alias("day"))


_STAR_SQL = """
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))
              AS revenue FROM lineitem) l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def sales(t: Tables) -> DataFrame:
    """Line items with their order, customer, nation and region. Revenue is in
    ten-thousandths: whole numbers add up exactly in any order of rows."""
    lines = project.derive(t.lineitem, [
        {"name": "cents", "expr": "CAST(rint(l_extendedprice * 100) AS BIGINT)"},
        {"name": "percent", "expr": "CAST(rint(l_discount * 100) AS BIGINT)"},
        {"name": "revenue", "expr": "CAST(cents * (100 - percent) AS DECIMAL(18,0))"}])
    return joins.star_join(lines, [
        (t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"),
        (t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"),
        (t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"),
        (t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")])


def _in_units(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") / 10000 for c in columns})


@query(f"""
    SELECT r_name, c_mktsegment, CAST(sum(revenue) AS DOUBLE) AS revenue,
           CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, count(*) AS l_orderkey
    {_STAR_SQL} WHERE r_name IS NOT NULL AND c_mktsegment IS NOT NULL
    GROUP BY r_name, c_mktsegment
""")
def star_join(t: Tables) -> DataFrame:
    out = aggregates.aggregate(sales(t), ["r_name", "c_mktsegment"],
                               {"revenue": "sum", "l_quantity": "sum", "l_orderkey": "count"})
    return _in_units(out, "revenue")


@query(f"""
    WITH full_rows AS (SELECT r_name, c_mktsegment, l_returnflag, revenue, l_quantity {_STAR_SQL})
    SELECT 'by_region' AS source_label, r_name, NULL AS c_mktsegment,
           CAST(sum(revenue) AS DOUBLE) AS revenue, sum(l_quantity) AS l_quantity,
           CAST(NULL AS DOUBLE) AS "A", CAST(NULL AS DOUBLE) AS "N", CAST(NULL AS DOUBLE) AS "R"
    FROM full_rows WHERE r_name IS NOT NULL GROUP BY r_name
    UNION ALL
    SELECT 'by_segment', NULL, c_mktsegment, CAST(sum(revenue) AS DOUBLE), sum(l_quantity),
           NULL, NULL, NULL
    FROM full_rows WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
    UNION ALL
    SELECT 'matrix', r_name, NULL, NULL, NULL,
           coalesce(CAST(sum(revenue) FILTER (l_returnflag = 'A') AS DOUBLE), 0),
           coalesce(CAST(sum(revenue) FILTER (l_returnflag = 'N') AS DOUBLE), 0),
           coalesce(CAST(sum(revenue) FILTER (l_returnflag = 'R') AS DOUBLE), 0)
    FROM full_rows WHERE r_name IS NOT NULL GROUP BY r_name
""")
def executive_report(t: Tables) -> DataFrame:
    """Star join, three reports on it, stacked with labels: one aggregate by
    grouping sets, whose third set is spread over the return flags."""
    base = sales(t).groupBy("r_name", "c_mktsegment", "l_returnflag").agg(
        F.sum("revenue").alias("revenue"), F.sum("l_quantity").alias("l_quantity"))
    region, segment, flag = F.col("r_name"), F.col("c_mktsegment"), F.col("l_returnflag")
    sets_ = base.groupingSets([[region], [segment], [region, flag]], region, segment, flag).agg(
        F.grouping_id().alias("set"), F.sum("revenue").alias("revenue"),
        F.sum("l_quantity").alias("l_quantity"))
    # The bits say which keys a set leaves out: region 4, segment 2, flag 1.
    label = F.when(F.col("set") == 3, "by_region").when(F.col("set") == 5, "by_segment").otherwise("matrix")
    matrix = F.col("set") == 2
    known = F.when(F.col("set") == 5, segment.isNotNull()).otherwise(region.isNotNull())
    cells = [F.when(F.max(matrix), F.coalesce(F.sum(F.when(flag == f, F.col("revenue"))), F.lit(0))).alias(f)
             for f in ("A", "N", "R")]
    out = sets_.where(known).groupBy(label.alias("source_label"), region, segment).agg(
        F.sum(F.when(~matrix, F.col("revenue"))).alias("revenue"),
        F.sum(F.when(~matrix, F.col("l_quantity"))).alias("l_quantity"), *cells)
    return _in_units(out, "revenue", "A", "N", "R")


# -- aggregates -------------------------------------------------------------


@query("""
    SELECT l_returnflag, sum(q) AS a, count(q) AS b, max(q) AS c FROM (
        SELECT l_returnflag, CASE WHEN l_linenumber < 3 THEN l_quantity END AS q FROM lineitem)
    GROUP BY l_returnflag
""")
def agg_nan(t: Tables) -> DataFrame:
    """NaN is missing in measures."""
    q = F.when(F.col("l_linenumber") < 3, F.col("l_quantity")).when(
        F.col("l_linenumber") == 3, F.lit(float("nan")))
    rows = t.lineitem.select("l_returnflag", *[q.alias(n) for n in "abc"])
    return aggregates.aggregate(rows, "l_returnflag", {"a": "sum", "b": "count", "c": "max"})

_SIMPLE = {
    "sum": "CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE)",
    "mean": "avg(CAST(round(o_totalprice * 100) AS BIGINT))",
    "count": "count(o_totalprice)",
    "min": "min(o_totalprice)", "max": "max(o_totalprice)",
    "std": "round(stddev_samp(o_totalprice), 4)",
}


def _grouped(t: Tables, func: str) -> DataFrame:
    orders = t.orders if func == "std" else exact(t.orders, "o_totalprice")
    if func == "mean":
        orders = in_cents(t.orders, "o_totalprice")
    out = aggregates.aggregate(orders, ["o_orderpriority", "o_orderstatus"],
                               {"o_totalprice": func})
    if func == "count":
        return out
    out = as_double(out, "o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4)) if func == "std" else out


for _func, _expr in _SIMPLE.items():
    register(f"agg_{_func}", lambda t, func=_func: _grouped(t, func), f"""
        SELECT o_orderpriority, o_orderstatus, {_expr} AS o_totalprice
        FROM orders GROUP BY o_orderpriority, o_orderstatus""")


def _edge(t: Tables, func: str) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice",
                           F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))
    out = aggregates.aggregate(rows, "o_custkey", {"o_totalprice": func, "o_orderstatus": func},
                               order_by=["o_orderdate", "o_orderkey"])
    return out


for _func, _pick in (("first", "arg_min"), ("last", "arg_max")):
    register(f"agg_{_func}", lambda t, func=_func: _edge(t, func), f"""
        SELECT o_custkey, {_pick}(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice,
               {_pick}(o_orderstatus, (o_orderdate, o_orderkey))
                   FILTER (o_orderstatus IS NOT NULL) AS o_orderstatus
        FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice,
                     nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)
        GROUP BY o_custkey""")


@query("""
    SELECT status, CAST(coalesce(sum(price), 0) AS DOUBLE) AS price, count(price) AS n
    FROM (SELECT nullif(o_orderstatus, 'F') AS status,
                 CASE WHEN o_orderstatus <> 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END
                     AS price FROM orders)
    WHERE status IS NOT NULL GROUP BY status
""")
def agg_null_keys(t: Tables) -> DataFrame:
    """The missing key is left out; the sum of a group without values is 0."""
    rows = exact(t.orders, "o_totalprice").select(
        F.expr("nullif(o_orderstatus, 'F')").alias("status"),
        F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END").alias("price"))
    out = aggregates.aggregate(rows.withColumn("n", F.col("price")), "status",
                               {"price": "sum", "n": "count"})
    return as_double(out, "price")


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type")
def agg_count_rows(t: Tables) -> DataFrame:
    return aggregates.count_rows(t.events, "event_type")


@query("""
    SELECT p_brand, count(*) AS n_rows FROM part WHERE p_brand IS NOT NULL
    GROUP BY p_brand ORDER BY n_rows DESC, p_brand
""")
def value_counts(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.part, "p_brand")


@query("""
    SELECT l_returnflag, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice,
           max(l_tax) AS l_tax FROM lineitem GROUP BY l_returnflag
""")
def agg_multi(t: Tables) -> DataFrame:
    return aggregates.agg_multi(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], "max",
                                "l_returnflag")


@query("""
    SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice
    FROM lineitem
""")
def agg_global(t: Tables) -> DataFrame:
    names = ["l_quantity", "l_extendedprice"]
    return as_double(aggregates.agg_multi(exact(t.lineitem, *names), names, "sum"), *names)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct(t: Tables) -> DataFrame:
    return aggregates.distinct(t.events, ["user_id", "event_type"])


@query("""
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
           CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) + 1 AS INTEGER) AS days,
           round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
                 / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0), 4)
               AS unit_cost
    FROM lineitem GROUP BY year(l_shipdate)
""")
def group_kpi(t: Tables) -> DataFrame:
    out = aggregates.group_kpi(exact(t.lineitem, "l_quantity", "l_extendedprice"),
                               "l_shipdate", "l_quantity", "l_extendedprice")
    return as_double(out, "quantity", "amount", "unit_cost")


_PIVOT = {
    "sum": "CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER ({w}), 0) AS DOUBLE)",
    "mean": "coalesce(avg(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER ({w}), 0)",
    "count": "CAST(count(o_totalprice) FILTER ({w}) AS DOUBLE)",
    "min": "coalesce(min(o_totalprice) FILTER ({w}), 0)",
    "max": "coalesce(max(o_totalprice) FILTER ({w}), 0)",
}


def _pivot(t: Tables, func: str) -> DataFrame:
    rows = (in_cents if func == "mean" else exact)(t.orders, "o_totalprice")
    out = pivots.pivot(rows, "o_custkey", "o_orderstatus", "o_totalprice", func,
                       column_values=["F", "O", "P"])
    return as_double(out, "F", "O", "P")


for _func, _expr in _PIVOT.items():
    register("pivot" if _func == "sum" else f"pivot_{_func}",
             lambda t, func=_func: _pivot(t, func),
             "SELECT o_custkey, " + ", ".join(
                 _expr.format(w=f"o_orderstatus = '{s}'") + f' AS "{s}"' for s in "FOP")
             + " FROM orders GROUP BY o_custkey")


@query("""
    SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
""")
def unpivot(t: Tables) -> DataFrame:
    return pivots.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"],
                          ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("""
    SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part
    UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part
""")
def unpivot_mixed(t: Tables) -> DataFrame:
    return pivots.unpivot(t.part.select("p_partkey", "p_brand", "p_size"), "p_partkey")


# -- sorts and limits -------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def sort(t: Tables) -> DataFrame:
    return ranking.sort(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", False)


@query("""
    SELECT month_name, min(m) AS m
    FROM (SELECT strftime(o_orderdate, '%b') AS month_name,
                 CAST(month(o_orderdate) AS INTEGER) AS m FROM orders)
    GROUP BY month_name ORDER BY m
""")
def sort_by_other(t: Tables) -> DataFrame:
    months = t.orders.select(F.date_format("o_orderdate", "MMM").alias("month_name"),
                             F.month("o_orderdate").alias("m"))
    return ranking.sort_by_other(months, "month_name", "m")


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 200
""")
def top_k(t: Tables) -> DataFrame:
    return ranking.top_k(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                         "o_totalprice", 200)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def page(t: Tables) -> DataFrame:
    return ranking.page(t.part.select("p_partkey", "p_name"), "p_name", 50, 100)


@query("""
    SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice FROM lineitem
    ORDER BY l_linenumber, l_orderkey, l_shipdate, l_quantity, l_extendedprice
    LIMIT 100 OFFSET (SELECT count(*) // 2 FROM lineitem)
""")
def page_deep(t: Tables) -> DataFrame:
    """The page in the middle of the table, by a column of seven values."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    return ranking.page(rows, "l_linenumber", 100, rows.count() // 2)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 "
       "ORDER BY o_orderkey LIMIT 50")
def page_after(t: Tables) -> DataFrame:
    return ranking.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 50, 500)


@query("""
    SELECT flag, part, l_quantity FROM (
        SELECT *, rank() OVER (ORDER BY flag ASC NULLS LAST, part) AS r FROM (
            SELECT nullif(l_returnflag, 'A') AS flag, l_partkey % 50 AS part, l_quantity FROM lineitem)
        WHERE (flag = 'R' AND part > 47) OR flag IS NULL) WHERE r <= 2000
""")
def page_after_ties(t: Tables) -> DataFrame:
    """A key of two columns with many ties, missing values last."""
    rows = t.lineitem.select(F.expr("nullif(l_returnflag, 'A')").alias("flag"),
                             (F.col("l_partkey") % 50).alias("part"), "l_quantity")
    return ranking.page_after(rows, ["flag", "part"], 2000, ("R", 47))


# -- unions -----------------------------------------------------------------


@query("""
    SELECT c_name AS name, c_acctbal AS balance, NULL AS p_brand, 'customer' AS source_label
    FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier
    UNION ALL SELECT p_name, NULL, p_brand, 'part' FROM part
""")
def merge_union_all(t: Tables) -> DataFrame:
    return sets.merge_union_all([
        (t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
         "customer"),
        (t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
         "supplier"),
        (t.part.select(F.col("p_name").alias("name"), "p_brand"), "part")])


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS ref, c_name AS name FROM customer
    UNION ALL SELECT p_brand, p_name FROM part
""")
def coerce_mixed(t: Tables) -> DataFrame:
    return sets.stack([t.customer.select(F.col("c_custkey").alias("ref"),
                                         F.col("c_name").alias("name")),
                       t.part.select(F.col("p_brand").alias("ref"), F.col("p_name").alias("name"))])


@query("""
    SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
""")
def union_distinct(t: Tables) -> DataFrame:
    return sets.union_distinct([t.customer.select(F.col("c_nationkey").alias("nationkey")),
                                t.supplier.select(F.col("s_nationkey").alias("nationkey"))])
