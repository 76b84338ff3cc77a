import re

import pytest
from pyspark.sql import functions as F

from stratawork.operators import aggregates, joins, pivots, project, ranking, sets

# -- projections ------------------------------------------------------------


def test_select_order_and_unknown(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert project.select(df, ["c", "a"]).columns == ["c", "a"]
    with pytest.raises(KeyError):
        project.select(df, ["a", "nope"])


def test_derive_uses_earlier_columns(spark, rows):
    df = spark.createDataFrame([(2, 3), (None, 1)], "a int, b int")
    out = project.derive(df, [{"name": "s", "expr": "a + b"},
                              {"name": "s2", "expr": "s * 2"}, {"name": "a", "expr": "b"}])
    assert rows(out, "a", "s", "s2") == [(1, None, None), (3, 5, 10)]


@pytest.mark.parametrize("spec", [
    {"name": "x"}, {"name": "x", "expr": "1", "mapping": {}}, {"name": "x", "mapping": {1: "a"}}])
def test_derive_errors(spark, spec):
    with pytest.raises(ValueError):
        project.derive(spark.range(1), [spec])


@pytest.mark.parametrize("more", [0, 700])
def test_mapping_is_the_same_for_any_length(spark, rows, more):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c"), (None, "d")], "k int, v string")
    extra = {1000 + i: 5 for i in range(more)}
    out = project.derive_mapping(df, "l", "k", {1.0: 10, 2.0: 20, **extra})
    assert rows(out) == [(1, "a", 10), (2, "b", 20), (9, "c", None), (None, "d", None)]
    assert out.schema["l"].dataType.simpleString() == "bigint"
    text = {"1": "one", "2": "two", "x": "never", None: "never", **{str(k): "" for k in extra}}
    out = project.derive_mapping(df, "k", "k", text)
    assert out.columns == ["k", "v"]
    assert rows(out, "v", "k") == [("a", "one"), ("b", "two"), ("c", None), ("d", None)]
    with pytest.raises(ValueError):
        project.derive_mapping(df, "l", "k", {"1": "one", "1.0": "uno", "01": "eins", **extra})


def test_drop_nulls_and_constant(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a int, b string")
    assert rows(project.drop_nulls(df)) == [(2, "x")]
    assert rows(project.drop_nulls(df, "a"), "a") == [(1,), (2,)]
    assert rows(project.add_constant(df, "a", 7), "a") == [(1,), (2,), (None,)]
    assert rows(project.add_constant(df, "a", 7, replace=True), "a") == [(7,)] * 3


def test_rename_safe_collision(spark):
    with pytest.raises(ValueError):
        project.rename_safe(spark.createDataFrame([(1, 2)], ["a b", "a_b"]))


# -- joins ------------------------------------------------------------------


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k int, v string")
    return left, right


INNER = [(2, "b", "x"), (2, "b", "y"), (2, "c", "x"), (2, "c", "y"), (None, "n", "m")]
LEFT, RIGHT = [(1, "a", None)], [(3, None, "z")]


@pytest.mark.parametrize("how, want", [
    ("inner", INNER), ("left", INNER + LEFT), ("right", INNER + RIGHT),
    ("outer", INNER + LEFT + RIGHT)])
def test_join(sides, rows, how, want):
    out = joins.join(*sides, "k", how)
    assert out.columns == ["k", "v_x", "v_y"]
    assert set(rows(out)) == set(want) and out.count() == len(want)


@pytest.mark.parametrize("how, want", [
    ("left", INNER + LEFT), ("right", INNER + RIGHT), ("outer", INNER + LEFT + RIGHT)])
def test_join_of_large_sides(sides, rows, no_broadcast, how, want):
    out = joins.join(*sides, "k", how, ("_l", "_r"))
    assert set(rows(out)) == set(want) and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_join_composite_key_self_and_errors(sides, rows):
    left, _ = sides
    assert joins.join(left, left, ["k", "v"]).count() == 4
    with pytest.raises(KeyError):
        joins.join(left, left, "nope")
    with pytest.raises(ValueError):
        joins.join(left, left, "k", "cross")
    with pytest.raises(ValueError):
        joins.join(left, left, "k", suffixes=("", ""))
    assert joins.join(left, left.limit(0), "k", "left").count() == 4
    assert joins.join(left.limit(0), left, "k", "outer").count() == 4


def test_membership(sides, rows):
    left, right = sides
    assert rows(joins.semi_join(left, right, "k"), "v") == [("b",), ("c",), ("n",)]
    assert rows(joins.anti_join(left, right, "k"), "v") == [("a",)]
    flagged = joins.with_membership(left, "k", right, "k")
    assert rows(flagged, "v", "is_member") == [
        ("a", False), ("b", True), ("c", True), ("n", True)]


# -- aggregates -------------------------------------------------------------


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), ("b", 1, None), (None, 1, 5.0)],
        "g string, t int, x double")


@pytest.mark.parametrize("func, a, b", [
    ("sum", 40.0, 0.0), ("mean", 20.0, None), ("count", 2, 0), ("min", 10.0, None),
    ("max", 30.0, None), ("std", 200 ** 0.5, None), ("first", 10.0, None), ("last", 30.0, None)])
def test_aggregate(sales, rows, func, a, b):
    out = aggregates.aggregate(sales, "g", {"x": func}, order_by="t")
    got = dict(rows(out))
    assert got["a"] == pytest.approx(a) and got["b"] == b and set(got) == {"a", "b"}


def test_aggregate_errors_and_empty(sales):
    with pytest.raises(ValueError):
        aggregates.aggregate(sales, "g", {"x": "first"})
    with pytest.raises(ValueError):
        aggregates.aggregate(sales, "g", {"x": "median"})
    with pytest.raises(KeyError):
        aggregates.aggregate(sales, "g", {"y": "sum"})
    assert aggregates.aggregate(sales.limit(0), "g", {"x": "sum"}).count() == 0


def test_std_of_one_row_is_null(sales, rows):
    one = sales.where("t = 3")
    assert rows(aggregates.aggregate(one, "g", {"x": "std"})) == [("a", None)]


def test_last_takes_whole_order_with_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 2, 9)], "g string, t int, x int, y int")
    out = aggregates.aggregate(df, "g", {"x": "last", "y": "last"}, order_by="t")
    assert rows(out)[0][1:] in [(5, 1), (2, 9)]  # one row wins for both columns


def test_counts(sales, rows):
    assert rows(aggregates.count_rows(sales, "g")) == [("a", 3), ("b", 1)]
    assert [tuple(r) for r in aggregates.value_counts(sales, "t").collect()] == [
        (1, 3), (2, 1), (3, 1)]
    assert rows(aggregates.agg_multi(sales, ["t", "x"], "max")) == [(3, 30.0)]
    assert aggregates.distinct(sales, "g").count() == 3


# -- pivots -----------------------------------------------------------------


def test_pivot(spark, rows):
    df = spark.createDataFrame(
        [("r", "p", 1), ("r", "p", 2), ("r", "q", None), ("s", "q", 4), (None, "p", 9),
         ("r", None, 9)], "i string, c string, v int")
    assert rows(pivots.pivot(df, "i", "c", "v")) == [("r", 3, 0), ("s", 0, 4)]
    assert rows(pivots.pivot(df, "i", "c", "v", "mean", -1)) == [("r", 1.5, -1.0), ("s", -1.0, 4.0)]
    assert rows(pivots.pivot(df, "i", "c", "v", "count", column_values=["q"])) == [
        ("r", 0), ("s", 1)]
    assert rows(pivots.pivot(df, "i", "c", "v", "max", None)) == [("r", 2, None), ("s", None, 4)]
    with pytest.raises(ValueError):
        pivots.pivot(df, "i", "c", "v", "median")


def test_unpivot_of_pivot_is_the_table(spark, rows):
    df = spark.createDataFrame([(i, c, i * 10 + n) for i in range(4)
                                for n, c in enumerate("xyz")], "i int, variable string, value int")
    wide = pivots.pivot(df, "i", "variable", "value")
    assert rows(pivots.unpivot(wide, "i"), "i", "variable", "value") == rows(df)


def test_unpivot_mixed(spark, rows):
    df = spark.createDataFrame([(1, "a", 2.5)], "i int, s string, d double")
    assert rows(pivots.unpivot(df, "i")) == [(1, "d", "2.5"), (1, "s", "a")]


# -- order and unions -------------------------------------------------------


def test_sort_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in ranking.sort(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in ranking.sort(df, "x", False).collect()] == [2, 1, None]


def test_pages_cover_the_table(spark):
    df = spark.range(25).withColumn("v", F.col("id") % 3)
    paged = [r.id for o in range(0, 30, 7) for r in ranking.page(df, "v", 7, o).collect()]
    assert sorted(paged) == list(range(25))
    seen, last = [], None
    while part := [r.id for r in ranking.page_after(df, "id", 10, last).collect()]:
        seen, last = seen + part, part[-1]
    assert seen == list(range(25))


def test_pages_by_key_with_ties_and_missing(spark):
    values = [(a, b, i) for i, (a, b) in enumerate(
        [(1, 1), (1, 1), (1, 2), (1, None), (2, 1), (2, None), (None, 1), (None, None), (None, None)] * 2)]
    df = spark.createDataFrame(values, "a int, b int, i int")
    seen, last = [], None
    while part := ranking.page_after(df, ["a", "b"], 3, last).collect():
        seen += [tuple(r) for r in part]
        last = (part[-1].a, part[-1].b)
    assert seen == sorted(values, key=lambda r: tuple((v is None, v or 0) for v in r))


def test_page_keeps_the_ties_spread(spark):
    """No task sees all rows of the last key; limits beyond the table, and none."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    page = ranking.page_after(df, "k", 10)
    assert not re.search("Window|SinglePartition", page._jdf.queryExecution().optimizedPlan().toString())
    assert [r.k for r in page.collect()] == [0] * 1000
    assert ranking.page_after(df, "k", 1001).count() == 2000
    assert ranking.page_after(df, "v", 1600, 2).where("v is null").count() == 1500
    assert ranking.page_after(df, "k", 9999, 0).count() == 2000
    assert ranking.page_after(df, "k", 10, 2).count() == ranking.page_after(df, "k", 0).count() == 0


def test_union(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([("7", 2.5)], "k string, d double")
    out = sets.merge_union_all([(a, "a"), (b, None)])
    assert rows(out, "k", "s", "d", "source_label") == [
        ("1", "x", None, "a"), ("7", None, 2.5, None)]
    assert sets.union_distinct([a, a, a.select("s", "k")]).count() == 1
    wide = sets.stack([a.select("k"), b.select(F.col("d").alias("k"))])
    assert wide.schema["k"].dataType.simpleString() == "double"


@pytest.mark.parametrize("keys", [["k"], ["s", "k"], ["t"], ["d"], ["b", "v"]])
def test_deep_pages_are_sought(spark, monkeypatch, keys):
    """Hot and missing keys, ties, copies of rows, NaN, texts that begin alike."""
    monkeypatch.setattr(ranking, "RANKED", 40)
    monkeypatch.setattr(ranking, "RANGES", 8)
    df = spark.range(1200).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id % 200 END AS k",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat(repeat('x', 70), id % 300) END AS s",
        "CASE WHEN id % 4 = 0 THEN double('NaN') WHEN id % 4 = 1 THEN -0.0D ELSE id / 7 END AS v",
        "timestampadd(MICROSECOND, id * 7777, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS t",
        "CAST(id / 13 AS decimal(20, 6)) AS d", "id % 2 = 0 AS b").union(
        spark.sql("SELECT 7L, 'y', 1D, TIMESTAMP_NTZ '2024-01-01', 1.5BD, true FROM range(300)"))
    every = [str(r) for r in df.orderBy(*ranking.total_order(df, keys)).collect()]
    for offset in (41, 333, 750, 1100, 1495):
        got = ranking.page(df, keys, 30, offset).collect()
        assert [str(r) for r in got] == every[offset:offset + 30], offset
    assert ranking.page(df, keys, 30, 5000).count() == 0
    assert ranking.page(df.limit(0), keys, 30, 50).count() == 0


def test_a_deep_page_ranks_few_rows(spark):
    """Half of the rows lie before the page; few are left to rank."""
    df = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id % 1000 END AS k", "id AS v")
    rows, offset = ranking.sought(df, ["k", "v"], 20, 150_000)
    assert offset <= ranking.RANKED and rows.count() <= 2 * ranking.RANKED
    assert [r.v for r in ranking.page(df, "k", 3, 50_000).collect()] == [
        r.v for r in df.orderBy("k", "v").offset(50_000).limit(3).collect()]
