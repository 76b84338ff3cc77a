"""Plan shapes: what reaches the scan, what is shuffled, what a hot key does."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratawork.operators import aggregates, gaps, groups, incremental, joins, project, quality
from stratawork.plans.registry import Tables
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan adaptive execution ended with."""
    df.collect()
    text = plan(df)
    return text[text.index("Final Plan"):]


@pytest.fixture
def t(spark):
    return Tables(spark, DATA)


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["filter"](spark, DATA))
    assert "GreaterThan(l_quantity,30.0)" in text[text.index("PushedFilters"):]
    schema = text[text.index("ReadSchema"):]
    assert schema.count(":") - 1 == 5 and "Exchange" not in text


@pytest.mark.parametrize("name", ["star_join", "agg_last", "pivot", "dedup_last", "upsert",
                                  "reindex_day_ffill", "dq_suite", "chart_histogram",
                                  "accumulate_dedup", "join_outer", "chart_pie", "cross_join"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    for bad in ("Cartesian", "NestedLoop", "Python", "Pandas"):
        assert bad not in text


def test_accumulate_does_not_shuffle(t):
    rows = t.events.withColumn("date", F.col("ts").cast("date"))
    out = incremental.accumulate(rows, rows.where("date = '2024-01-03'"), "date", "2024-01-03")
    assert "Exchange" not in plan(out)


def test_accumulate_prunes_the_date_partition(spark, tmp_path):
    spark.range(30).withColumn("date", F.concat(F.lit("2024-01-1"), F.col("id") % 3)) \
        .write.partitionBy("date").parquet(str(tmp_path / "t"))
    table = spark.read.schema("id bigint, date string").parquet(str(tmp_path / "t"))
    out = incremental.accumulate(table, table.limit(0), "date", "2024-01-11")
    assert "PartitionFilters: [(isnull(date" in plan(out)


def test_first_rows_are_limited_before_the_shuffle(t):
    for out in (groups.deduplicate(t.lineitem, ["l_orderkey"], "last", "l_shipdate"),
                groups.last_per_group(t.events, "user_id", "ts", whole_row=True)):
        text = plan(out)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_aggregates_have_a_partial_step(t):
    for func in aggregates.FUNCTIONS:
        text = plan(aggregates.aggregate(t.orders, "o_custkey", {"o_totalprice": func},
                                         order_by="o_orderdate"))
        assert "partial_" in text[text.index("Exchange"):]


def test_first_and_last_read_only_their_columns(t):
    out = aggregates.aggregate(t.orders, "o_custkey", {"o_totalprice": "last"},
                               order_by="o_orderdate")
    schema = plan(out)
    schema = schema[schema.index("ReadSchema"):].splitlines()[0]
    assert schema == "ReadSchema: struct<o_custkey:bigint,o_totalprice:double," \
        "o_orderdate:timestamp_ntz>"


@pytest.mark.parametrize("name, copies", [("reindex_day_ffill", 5), ("reindex_month", 5), ("reindex_day_zero", 3),
                                          ("reindex_year", 3), ("reindex_week", 2), ("reindex_keeps_rows", 2)])
def test_series_find_their_ends_once(spark, name, copies):
    """Rows, rows with holes, the summary for these and for the gaps, and one subquery;
    a join of all rows with the summary would need fewer copies and shuffle them all."""
    text = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line for line in text.splitlines()) <= copies
    assert text.count("scalar-subquery") <= 1


@pytest.mark.parametrize("entries", [3, 600])
def test_mappings_are_broadcast(t, entries):
    out = project.derive_mapping(t.lineitem, "label", "l_linenumber", {i: f"v{i}" for i in range(entries)})
    text = plan(out)
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text


@pytest.fixture
def hot(spark, tmp_path):
    """A third of 60 000 rows share one key."""
    path = str(tmp_path / "hot")
    spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad")) \
        .write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def small_skew(spark):
    """Thresholds under which the test table counts as large."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
              "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_hot_key_of_an_outer_join_is_split(spark, hot, small_skew, how):
    few = spark.createDataFrame([(7, "x"), (-1, "y"), (1, "z")], "k bigint, w string")
    sides = (few, hot) if how != "right" else (hot, few)
    out = joins.join(*sides, "k", how)
    text = final_plan(out)
    assert "skew=true" in text and "ReusedExchange" in text
    n_hot = 20_001  # key 7: the multiples of three, and id 7 itself
    want = {"left": n_hot + 2, "right": n_hot + 2, "outer": 60_000 + 1}[how]
    assert out.count() == want


def test_hot_value_is_counted_once_before_joining(spark, hot, small_skew):
    use = quality.Expectation("in_other", {"x": "h.k", "y": "o.k"})
    out = quality.run_suite([use], {"h": hot, "o": spark.range(8).toDF("k")})
    got = out.first()
    assert got.total == 60_000 and got.total - got.failed == 20_001 + 4
    text = plan(out)
    assert "Join" not in text and "partial_sum" in text[text.index("Exchange"):]


def test_hot_group_of_a_series(spark, small_skew):
    """A third of all rows in one group and on one day, some of them missing."""
    df = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50))
        .alias("g"),
        F.when(F.col("id") % 3 == 0, "2024-01-05").otherwise(
            F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 9 + 1).cast("string"), 2, "0")))
        .alias("date"),
        F.when(F.col("id") % 10 != 0, F.col("id")).alias("n"))
    out = gaps.reindex_series(df, group_by="g", fill="ffill")
    dates = df.agg(F.countDistinct("g", "date").alias("seen"), F.countDistinct("g").alias("g")).first()
    assert out.count() == 30_000 + 8 * dates.g - dates.seen
    assert out.where("g = 'hot' AND date >= '2024-01-05' AND n IS NULL").count() == 0
    windows = [line for line in plan(out).splitlines() if "Window" in line]
    assert windows and all("__period" in line for line in windows)


def test_hot_key_duplicates(hot, small_skew):
    out = groups.flag_duplicates(hot, "k", "v")
    assert out.where("is_duplicate").count() == 20_000
    assert groups.deduplicate(hot, "k", "first", "v").where("k = 7").first().v == 0
    assert groups.deduplicate(hot, "k", False).count() == 60_000 - 20_001


@pytest.mark.parametrize("name, table, copies", [
    ("chart_histogram", "value", 4),  # the data, and three uses of one subquery, which runs once
    ("chart_radar", "l_returnflag", 2), ("executive_report", "l_returnflag", 2)])
def test_copies_of_the_input_in_the_plan(spark, name, table, copies):
    df = entry.queries()[name](spark, DATA)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in text.splitlines() if "Relation [" in line and table in line]
    assert 1 <= len(scans) <= copies
