"""Scans, sinks, versions, lineage, landed data and streamed deliveries. Files
go to a scratch folder that all executors can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import finite_columns
from ..operators.quality import Expectation
from ..sources import files, jdbc, landed, lineage, maintained, schemas, slices
from ..sources.versions import Store
from ..streaming import deliveries
from .registry import Tables, day_text, query, register, time_text

# -- files ------------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def scan_parquet(t: Tables) -> DataFrame:
    return files.scan(t.spark, f"{t.folder}/lineitem.parquet") \
        .where("l_quantity >= 49").select("l_orderkey", "l_quantity")


def _round_trip(t: Tables, fmt: str) -> DataFrame:
    """Write and read back, types given by a schema."""
    rows = t.events.select("event_id", "user_id", "event_type", "value", "props",
                           F.expr("nullif(event_type, 'click')").alias("maybe"))
    path = files.scratch(t.spark)
    files.sink(rows, path, fmt)
    return files.scan(t.spark, path, fmt, schema=None if fmt == "parquet" else rows.schema)


for _fmt in files.FORMATS:
    register(f"sink_{_fmt}", lambda t, f=_fmt: _round_trip(t, f),
             "SELECT event_id, user_id, event_type, value, props, "
             "nullif(event_type, 'click') AS maybe FROM events")


def _texts(t: Tables, fmt: str) -> DataFrame:
    """Whole documents and awkward cells, written and read back."""
    rows = t.documents.select("doc_id", "text", F.expr(
        """CASE doc_id % 4 WHEN 0 THEN '  ' || source || ' ' WHEN 1 THEN 'a "b", c' || lang
           WHEN 2 THEN '' END""").alias("cell"))
    path = files.scratch(t.spark)
    files.sink(rows, path, fmt)
    return files.scan(t.spark, path, fmt, schema=rows.schema)


for _fmt in ("csv", "tsv", "jsonl"):
    register(f"sink_{_fmt}_texts", lambda t, f=_fmt: _texts(t, f), """
        SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '  ' || source || ' '
            WHEN 1 THEN 'a "b", c' || lang WHEN 2 THEN '' END AS cell FROM documents""")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv_inferred(t: Tables) -> DataFrame:
    path = files.scratch(t.spark)
    files.sink(t.supplier, path, "csv")
    return files.scan(t.spark, path, "csv").withColumn("s_suppkey",
                                                       F.col("s_suppkey").cast("bigint"))


@query("""
    SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders
    WHERE o_orderstatus = 'O' GROUP BY o_custkey
""")
def scan_sql_query(t: Tables) -> DataFrame:
    return jdbc.scan_query(t.spark, """
        SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {orders}
        WHERE o_orderstatus = 'O' GROUP BY o_custkey""", views={"orders": t.orders})


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
def read_slice(t: Tables) -> DataFrame:
    rows = t.customer.select("c_acctbal", "c_custkey", "c_name")
    return slices.read_slice(rows, ["c_acctbal", "c_custkey"], 20, 40).select("c_custkey", "c_name")


_RATIO = "CASE WHEN p_size < 10 THEN CAST('Infinity' AS DOUBLE) " \
         "WHEN p_size > 40 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice / p_size END"


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_retailprice / p_size END AS ratio "
       "FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5")
def preview(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.expr(_RATIO).alias("ratio"))
    return slices.preview(rows, "p_partkey", 10, 5)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_retailprice / p_size END AS ratio "
       "FROM part")
def finite_values(t: Tables) -> DataFrame:
    return finite_columns(t.part.select("p_partkey", F.expr(_RATIO).alias("ratio")))


@query("SELECT count(*) AS n_rows, TRUE AS same FROM lineitem")
def content_checksum(t: Tables) -> DataFrame:
    """Equal for the same rows in another order, with other column order."""
    one = slices.content_checksum(t.lineitem)
    shuffled = t.lineitem.select(*reversed(t.lineitem.columns)).hint("rebalance")
    other = slices.content_checksum(shuffled).select("checksum").scalar()
    return one.select("n_rows", (F.col("checksum") == other).alias("same"))


# -- landed data ------------------------------------------------------------

# One body per event in the shapes responses take: a list, a well-known key, a
# key of its own, the only list among the values, and two unknown lists.
_RECORDS = "'[{\"id\": ' || event_id || ', \"kind\": \"' || event_type || '\"}, " \
           "{\"id\": ' || (event_id + 1) || ', \"kind\": null}]'"
_BODY = f"""CASE event_type
    WHEN 'click' THEN {_RECORDS}
    WHEN 'view' THEN '{{"total": 2, "results": ' || {_RECORDS} || ', "tags": ["x"]}}'
    WHEN 'purchase' THEN '{{"own": ' || {_RECORDS} || ', "data": [{{"id": -1}}]}}'
    WHEN 'signup' THEN '{{"page": 1, "things": ' || {_RECORDS} || '}}'
    ELSE '{{"one": [1], "two": [2], "text": "[3]"}}' END"""


@query("""
    SELECT event_id, event_id AS id, event_type AS kind FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, event_id + 1, NULL FROM events WHERE event_type <> 'error'
""")
def pages_to_rows(t: Tables) -> DataFrame:
    bodies = t.events.select("event_id", F.expr(_BODY).alias("body"))
    rows = landed.pages_to_rows(bodies, "body", data_key="own", schema="id bigint, kind string")
    return rows.select("event_id", "record.id", "record.kind")


@query("""
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events
""")
def flatten_json(t: Tables) -> DataFrame:
    parsed = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return landed.flatten_json(parsed)


@query("""
    SELECT event_id AS id, event_type AS user_kind, CAST(user_id AS VARCHAR) AS user_ref_id,
           event_type || ', ' || user_id AS tags,
           '[{"n":' || user_id || '}]' AS parts
    FROM events
""")
def flatten_json_nested(t: Tables) -> DataFrame:
    """JSON text with records, a list of texts and a list of records, its schema
    inferred from the data."""
    text = F.expr("""
        '{"id": ' || event_id || ', "user": {"kind": "' || event_type || '", "ref": {"id": "'
        || user_id || '"}}, "tags": ["' || event_type || '", "' || user_id
        || '"], "parts": [{"n": ' || user_id || '}]}'""")
    bodies = t.events.select(text.alias("body"))
    return landed.flatten_json(bodies, "body", landed.infer_json_schema(bodies, "body"))


@query("""
    SELECT 'customer' AS sheet, c_name AS name, CAST(c_custkey AS DOUBLE) AS code,
           TRY_CAST(CASE WHEN c_nationkey = 3 THEN 'unknown' ELSE CAST(c_acctbal AS VARCHAR) END
                    AS DOUBLE) AS amount
    FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'supplier', s_name, CAST(s_suppkey AS DOUBLE), NULL FROM supplier
""")
def clean_sheet(t: Tables) -> DataFrame:
    """Two tabs of text cells: rows without key dropped, numbers recognised."""
    first = t.customer.select(
        F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END").alias("name"),
        F.col("c_custkey").cast("string").alias("code"),
        F.expr("CASE WHEN c_nationkey = 3 THEN 'unknown' ELSE CAST(c_acctbal AS STRING) END")
        .alias("amount"))
    second = t.supplier.select(F.col("s_name").alias("name"),
                               F.col("s_suppkey").cast("string").alias("code"))
    return landed.clean_sheet({"customer": first, "supplier": second}, key_column=0)


# -- versions ---------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def scan_version(t: Tables) -> DataFrame:
    """The latest committed version of two."""
    store = Store(t.spark, files.scratch(t.spark))
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    store.write("crm/clean/customer", rows, {"run": 1})
    store.write("crm/clean/customer", rows.where("c_acctbal > 0"), {"run": 2})
    return store.read("crm/clean/customer")


@query("""
    SELECT 1 AS run, count(*) AS n_rows FROM orders
    UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'F'
""")
def skip_if_same_metadata(t: Tables) -> DataFrame:
    """A third commit with the metadata of the second is skipped; a deprecated
    version is not listed."""
    store, name = Store(t.spark, files.scratch(t.spark)), "sales/raw/orders"
    store.write(name, t.orders, {"run": 1})
    store.write(name, t.orders.where("o_orderstatus = 'F'"), {"run": 2})
    store.write(name, t.orders, {"run": 2})
    extra = store.write(name, t.orders, {"run": 2}, force=True)
    store.deprecate(name, extra.version)
    return store.list_versions(name).select(
        F.col("metadata").getItem("run").cast("int").alias("run"), "n_rows")


@query("""
    SELECT 1 AS run, 'deprecated' AS status, count(*) AS n_rows FROM customer
    UNION ALL SELECT 3, 'committed', count(*) FILTER (c_acctbal > 0) FROM customer
""")
def deprecate_version(t: Tables) -> DataFrame:
    """Three versions: the first hidden, the second deleted."""
    store, name = Store(t.spark, files.scratch(t.spark)), "crm/clean/customer"
    first = store.write(name, t.customer, {"run": 1})
    second = store.write(name, t.customer.where("c_acctbal <= 0"), {"run": 2})
    store.write(name, t.customer.where("c_acctbal > 0"), {"run": 3})
    store.deprecate(name, first.version)
    store.delete_version(name, second.version)
    return store.versions(name).select(
        F.col("metadata").getItem("run").cast("int").alias("run"), "status", "n_rows")


@query("""
    SELECT count(*) AS n_rows, 'direct' AS pii_type, 'full name' AS description FROM customer
""")
def annotate_columns(t: Tables) -> DataFrame:
    """Notes on a column, written with the table and read back from it."""
    path = files.scratch(t.spark)
    noted = schemas.annotate_columns(
        t.customer, {"c_name": {"pii_type": "direct", "description": "full name"}})
    files.sink(noted, path)
    back = files.scan(t.spark, path)
    notes = schemas.column_notes(back)["c_name"]
    return back.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", *[F.lit(notes[k]).alias(k) for k in ("pii_type", "description")])


@query("""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def virtual_dataset(t: Tables) -> DataFrame:
    store = Store(t.spark, files.scratch(t.spark))
    t.orders.createOrReplaceTempView("stratawork_orders")
    store.register_query("sales/view/urgent", "SELECT o_orderkey, o_totalprice "
                         "FROM stratawork_orders WHERE o_orderpriority = '1-URGENT'")
    return store.read("sales/view/urgent")


# Orders as texts of several kinds, some blank, some not what their column is.
_TEXTS = {"key": "CAST(o_orderkey AS {text})", "price": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text})",
          "open": "CASE WHEN o_orderstatus = 'O' THEN 'true' WHEN o_orderstatus = 'F' THEN 'False' ELSE ' ' END",
          "amount": "CASE WHEN o_orderkey % 2 = 0 THEN '7' WHEN o_orderstatus <> 'P' THEN '7.25' ELSE 'n/a' END",
          "status": "o_orderstatus", "code": "'0' || CAST(o_custkey AS {text})",
          "seen": "CASE WHEN o_orderstatus = 'P' THEN '{wrong}' ELSE '2024-02-29 10:00:00' END",
          "nothing": "CAST(NULL AS {text})"}


def _types_sql(rows: str) -> str:
    """The type of each column, each value tried in turn."""
    number = "[+-]?(0|[1-9][0-9]*)"
    each = " UNION ALL ".join(
        f"SELECT '{n}' AS name, trim({e.format(text='VARCHAR', wrong='2023-02-29')}) AS v FROM {rows}" for n, e in _TEXTS.items())
    return f"""(SELECT name, count(*) FILTER (v IS NULL OR v = '') AS n_missing, CASE
            WHEN bool_and(lower(v) IN ('true', 'false')) FILTER (v <> '') THEN 'boolean'
            WHEN bool_and(regexp_full_match(v, '{number}') AND TRY_CAST(v AS BIGINT) IS NOT NULL) FILTER (v <> '') THEN 'integer'
            WHEN bool_and(regexp_full_match(v, '{number}(\\.[0-9]+)?') AND TRY_CAST(v AS DOUBLE) IS NOT NULL) FILTER (v <> '') THEN 'decimal'
            WHEN bool_and(regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL)
                FILTER (v <> '') THEN 'datetime' ELSE 'string' END AS logical_type
        FROM ({each}) GROUP BY name)"""


def _text_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", *[
        F.expr(e.format(text="STRING", wrong="2023-02-29")).alias(n) for n, e in _TEXTS.items()])


@query(f"SELECT name, 'string' AS physical_type, logical_type, n_missing > 0 AS nullable, n_missing "
       f"FROM {_types_sql('orders')}")
def infer_schema(t: Tables) -> DataFrame:
    """Types of text columns, inferred from all their values."""
    return schemas.infer_types(_text_orders(t).select(*_TEXTS))


_FINISHED = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"


@query(f"""
    SELECT name, o.logical_type AS old_type, n.logical_type AS new_type,
           CASE WHEN n.logical_type IS NULL THEN 'missing' ELSE 'type_change' END AS change
    FROM {_types_sql(_FINISHED)} o LEFT JOIN (SELECT * FROM {_types_sql('orders')} WHERE name <> 'status') n USING (name)
    WHERE o.logical_type IS DISTINCT FROM n.logical_type
""")
def schema_diff(t: Tables) -> DataFrame:
    """Types of the finished orders against those of all, which lack a column."""
    rows = _text_orders(t)
    published = schemas.infer_types(rows.where("o_orderstatus = 'F'").select(*_TEXTS))
    return schemas.drift(published, schemas.infer_types(rows.select(*[c for c in _TEXTS if c != "status"])), "logical_type")


@query(f"""
    SELECT count(*) AS total, count(*) FILTER (n_missing > 0) AS pii, count(*) FILTER (logical_type = 'string') AS inferred,
           count(*) FILTER (logical_type <> 'string') AS draft, CAST(0 AS BIGINT) AS published
    FROM {_types_sql('orders')}
""")
def schema_summary(t: Tables) -> DataFrame:
    """Records of a committed version; notes are made from what the values say: typed
    columns get a draft, those with missing values are marked."""
    store, name = Store(t.spark, files.scratch(t.spark)), "sales/raw/orders"
    rows = _text_orders(t).select(*_TEXTS)
    store.write(name, rows)
    found = schemas.infer_types(store.read(name)).collect()
    store.define_columns(name, {r["name"]: {"logical_type": r["logical_type"]} for r in found if r["logical_type"] != "string"})
    noted = {r["name"]: r["nullable"] for r in found}
    return schemas.schema_summary(store.columns(name).withColumn(
        "pii", F.create_map(*[F.lit(v) for pair in noted.items() for v in pair])[F.col("name")]))


@query("""
    SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS total, CAST(1 AS BIGINT) AS passed,
           FALSE AS success
    FROM lineitem
""")
def dq_on_commit(t: Tables) -> DataFrame:
    """One of two expectations fails; the version is committed all the same."""
    store, name = Store(t.spark, files.scratch(t.spark)), "sales/raw/lines"
    store.write(name, t.lineitem, expectations=[
        Expectation("not_null", {"x": "this.l_orderkey"}),
        Expectation("between", {"x": "this.l_quantity"}, {"min_val": 0, "max_val": 10})])
    quality = store.quality(name).select("version", "total", "passed", "success")
    return store.list_versions(name).select("version", "n_rows").join(quality, "version") \
        .drop("version")


# -- lineage ----------------------------------------------------------------


def _edges(t: Tables) -> DataFrame:
    """Priorities as outputs made from the orders of a status, one edge per
    order, those of open orders reported twice."""
    edges = t.orders.select(
        F.concat(F.lit("priority/"), "o_orderpriority").alias("output_dataset"),
        F.year("o_orderdate").cast("string").alias("output_version"),
        F.concat(F.lit("status/"), "o_orderstatus").alias("input_dataset"),
        F.concat(F.lit("customer "), "o_custkey").alias("input_version"))
    return lineage.record(edges, edges.where("input_dataset = 'status/O'"))


_EDGES = """(SELECT DISTINCT 'priority/' || o_orderpriority AS output_dataset,
    CAST(year(o_orderdate) AS VARCHAR) AS output_version,
    'status/' || o_orderstatus AS input_dataset, 'customer ' || o_custkey AS input_version
    FROM orders)"""


@query(f"SELECT * FROM {_EDGES}")
def lineage_record(t: Tables) -> DataFrame:
    return _edges(t)


@query(f"SELECT DISTINCT input_dataset, input_version FROM {_EDGES} "
       "WHERE output_dataset = 'priority/1-URGENT'")
def lineage_upstream(t: Tables) -> DataFrame:
    return lineage.upstream(_edges(t), "priority/1-URGENT")


@query(f"SELECT DISTINCT output_dataset, output_version FROM {_EDGES} "
       "WHERE input_dataset = 'status/P'")
def lineage_downstream(t: Tables) -> DataFrame:
    return lineage.downstream(_edges(t), "status/P")


# -- streamed deliveries ----------------------------------------------------


def _stream(t: Tables, name: str) -> DataFrame:
    """A table of the test data as a delivery of chunks. The braces make a glob
    of the path: a file stream takes no single file otherwise."""
    return deliveries.chunks(t.spark, f"{t.folder}/{{{name}}}.parquet", getattr(t, name).schema)


@query("SELECT event_id, user_id, value FROM events")
def stream_append(t: Tables) -> DataFrame:
    root = files.scratch(t.spark)
    store = Store(t.spark, f"{root}/store")
    stream = _stream(t, "events").select("event_id", "user_id", "value")
    deliveries.stream_append(store, "web/raw/events", stream, f"{root}/staging", f"{root}/state")
    return store.read("web/raw/events")


_DATED = "SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS date FROM events"


@query(f"""
    SELECT * FROM ({_DATED}) WHERE date <> '2024-01-20'
    UNION ALL SELECT event_id, value + 1, date FROM ({_DATED}) WHERE date = '2024-01-20'
""")
def stream_accumulate(t: Tables) -> DataFrame:
    """History in a table partitioned by date, one day delivered again."""
    root = files.scratch(t.spark)
    history = t.events.select("event_id", "value", day_text("ts").alias("date"))
    files.sink(history, f"{root}/table", partition_by=["date"])
    today = _stream(t, "events").where("ts >= TIMESTAMP_NTZ '2024-01-20' "
                                       "AND ts < TIMESTAMP_NTZ '2024-01-21'")
    return deliveries.stream_accumulate_in_place(
        today.select("event_id", (F.col("value") + 1).alias("value")), f"{root}/table", "date",
        "2024-01-20", f"{root}/staging", f"{root}/state")


@query("""
    WITH today AS (
        SELECT user_id, max(value) AS value, max(seen) AS seen FROM (
            SELECT user_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r
            FROM events WHERE event_type = 'purchase') WHERE r = 1 GROUP BY user_id)
    SELECT user_id, value, seen FROM today
    UNION ALL
    SELECT user_id, CAST(0 AS DOUBLE), 'never' FROM (SELECT DISTINCT user_id FROM events)
    WHERE user_id NOT IN (SELECT user_id FROM today)
""")
def stream_upsert(t: Tables) -> DataFrame:
    """The last purchase of each user, upserted over a table of all users."""
    root = files.scratch(t.spark)
    store = Store(t.spark, f"{root}/store")
    users = t.events.select("user_id").distinct()
    store.write("web/clean/last", users.select(
        "user_id", F.lit(0.0).alias("value"), F.lit("never").alias("seen")))
    bought = _stream(t, "events").where("event_type = 'purchase'") \
        .select("user_id", "value", time_text("ts").alias("seen"))
    deliveries.stream_upsert(store, "web/clean/last", bought, "user_id",
                             f"{root}/staging", f"{root}/state", "day 1", order_by="seen")
    return store.read("web/clean/last")


@query("""
    SELECT CAST(o_orderkey % 16 AS INTEGER) AS bucket, count(*) AS n_before,
           count(*) FILTER (NOT (o_orderkey % 16 = 9 AND o_orderstatus = 'F')) AS n_after
    FROM orders GROUP BY 1
    HAVING bool_or(o_orderkey % 16 = 3 AND o_orderpriority = '1-URGENT') OR bool_or(o_orderkey % 16 = 9 AND o_orderstatus = 'F')
""")
def checksum_buckets(t: Tables) -> DataFrame:
    """Which buckets of the orders a new version changes: in one some cells, in
    another some rows are gone; digests are taken while writing."""
    store, name = Store(t.spark, files.scratch(t.spark)), "sales/raw/orders"
    rows = t.orders
    first = store.write(name, rows, digest_by="o_orderkey")
    changed = rows.where("NOT (o_orderkey % 16 = 9 AND o_orderstatus = 'F')").withColumn(
        "o_totalprice", F.expr("o_totalprice + CASE WHEN o_orderkey % 16 = 3 AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"))
    second = store.write(name, changed.hint("rebalance"), digest_by="o_orderkey")
    return store.changed_buckets(name, first.version, second.version)


# -- tables kept in parts ---------------------------------------------------


@query("""
    WITH all_rows AS (
        SELECT o_orderkey, o_custkey, o_totalprice, 0 AS delivery FROM orders WHERE o_orderstatus <> 'O'
        UNION ALL SELECT o_orderkey, o_custkey, -o_totalprice, 1 FROM orders WHERE o_orderkey % 100 = 7
        UNION ALL SELECT o_orderkey, -1, 0, 2 FROM orders WHERE o_custkey = 5)
    SELECT o_orderkey, o_custkey, o_totalprice FROM all_rows
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY delivery DESC) = 1
""")
def upsert_buckets(t: Tables) -> DataFrame:
    """Three deliveries into a table in buckets; the last touches few of them."""
    store, name = Store(t.spark, files.scratch(t.spark)), "sales/clean/orders"
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    maintained.upsert(store, name, t.orders.where("o_orderstatus <> 'O'").select(*columns), "o_orderkey")
    again = t.orders.where("o_orderkey % 100 = 7").withColumn("o_totalprice", -F.col("o_totalprice"))
    maintained.upsert(store, name, again.select(*columns), "o_orderkey")
    closed = t.orders.where("o_custkey = 5").select(
        "o_orderkey", F.lit(-1).cast("bigint").alias("o_custkey"), F.lit(0.0).alias("o_totalprice"))
    maintained.upsert(store, name, closed, "o_orderkey")
    return store.read(name)


_BY_DAY = "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS date FROM events"


@query(f"SELECT user_id, event_type, min(date) AS date FROM ({_BY_DAY}) "
       "WHERE date <= '2024-01-04' GROUP BY user_id, event_type")
def accumulate_dedup_index(t: Tables) -> DataFrame:
    """States of four days, one delivery a day, one of them late."""
    store, name = Store(t.spark, files.scratch(t.spark)), "web/clean/states"
    rows = t.events.select("user_id", "event_type", day_text("ts").alias("date"))
    for day in ("2024-01-01", "2024-01-03", "2024-01-02", "2024-01-04"):
        maintained.accumulate_dedup(store, name, rows.where(F.col("date") == day), "date", day)
    return store.read(name)
