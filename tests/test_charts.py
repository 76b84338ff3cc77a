import random

import numpy as np
import pandas as pd
import pytest

from stratawork.operators import charts


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("2024-01", "Electronics", 12000.0, 40, 2), ("2024-01", "Clothing", 5600.0, 80, 5),
         ("2024-01", "Food", 3200.0, 200, 1), ("2024-02", "Electronics", 13400.0, 45, 3),
         ("2024-02", "Clothing", 6100.0, 88, 4), ("2024-02", "Food", 3500.0, 210, 2),
         ("2024-03", "Electronics", 13700.0, 47, 1), ("2024-03", "Clothing", 6900.0, 95, 6),
         ("2024-03", "Food", 4100.0, 230, 3)],
        "date string, category string, revenue double, units bigint, returns bigint")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_bar(sales):
    assert tuples(charts.chart_xy(sales, "category", "revenue")) == [
        ("Clothing", 18600.0), ("Electronics", 39100.0), ("Food", 10800.0)]
    assert tuples(charts.chart_xy(sales, "category", "revenue", sort="desc", limit=1)) == [
        ("Food", 10800.0)]
    assert tuples(charts.chart_xy(sales, "category", agg="count", limit=2)) == [
        ("Clothing", 3), ("Electronics", 3)]


def test_numeric_categories_sort_as_text(spark):
    df = spark.createDataFrame([(10, 1.0), (9, 2.0), (10, 3.0), (None, 9.0)], "x int, y double")
    assert tuples(charts.chart_xy(df, "x", "y")) == [("10", 4.0), ("9", 2.0)]
    assert tuples(charts.chart_xy(df, "x", agg="count")) == [("10", 2), ("9", 1)]


def test_order_by_another_column(spark):
    df = spark.createDataFrame([("Feb", 2, 1.0), ("Jan", 1, 2.0), ("Apr", 4, 3.0)],
                               "m string, n int, y double")
    for kwargs in ({"y": "y"}, {"agg": "count"}):
        out = charts.chart_xy(df, "m", sort_field="n", **kwargs)
        assert [r.m for r in out.collect()] == ["Jan", "Feb", "Apr"]
    wide = charts.chart_xy_color(df, "m", "n", "y", sort_field="n", sort="desc")
    assert [r.m for r in wide.collect()] == ["Apr", "Feb", "Jan"]
    combo = charts.chart_combo(df, "m", [("y", "sum")], sort_field="n", limit=2)
    assert tuples(combo) == [("Jan", 2.0), ("Feb", 1.0)]


def test_colours(sales, spark):
    out = charts.chart_xy_color(sales, "date", "category", "revenue", sort="asc")
    assert out.columns == ["date", "Clothing", "Electronics", "Food"]
    assert tuples(out)[0] == ("2024-01", 5600.0, 12000.0, 3200.0) and out.count() == 3
    df = spark.createDataFrame([("a", "p", 1), ("b", "q", 2)], "x string, c string, y int")
    assert tuples(charts.chart_xy_color(df, "x", "c", agg="count")) == [
        ("a", 1.0, 0.0), ("b", 0.0, 1.0)]


def test_pie(sales):
    out = tuples(charts.chart_pie(sales, "category", "revenue"))
    assert [r[:2] for r in out] == [("Clothing", 18600.0), ("Electronics", 39100.0),
                                    ("Food", 10800.0)]
    assert sum(r[2] for r in out) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("values, bins", [
    ([2.0, 2.0], 2), ([0.0, 0.0, 0.0], 3), ([-5.0], 4), ([1.0, 2.0, 3.0, 4.0], 3),
    ([float(i) for i in range(21)], 20), ([0.1 * i for i in range(31)], 10)])
def test_histogram_equals_cut(spark, values, bins):
    counts = pd.cut(pd.Series(values), bins=bins).value_counts().sort_index()
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    out = charts.chart_histogram(df, "x", bins).collect()
    assert [r.n for r in out] == list(counts)


@pytest.mark.parametrize("seed", range(3))
def test_histogram_of_random_numbers(spark, seed):
    rnd = random.Random(seed)
    values = [rnd.choice([rnd.gauss(0, 5), float(rnd.randint(-9, 9))]) for _ in range(500)]
    bins = rnd.choice([1, 7, 20, 64])
    cut = pd.cut(pd.Series(values), bins=bins, retbins=True)
    out = charts.chart_histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", bins)
    rows = out.collect()
    assert [r.n for r in rows] == list(cut[0].value_counts().sort_index())
    assert sum(r.n for r in rows) == len(values)
    assert np.allclose([rows[0].lower] + [r.upper for r in rows], cut[1])


def test_histogram_of_nothing(spark):
    assert charts.chart_histogram(spark.createDataFrame([], "x double"), "x").count() == 0


def test_scatter(sales, spark):
    assert charts.chart_scatter(sales, "units", "revenue", "date").count() == 9
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x double, y double")
    assert tuples(charts.chart_scatter(df, "x", "y", "x", 1)) == [(2.0, 3.0)]


def test_radar(sales, spark):
    out = charts.chart_radar(sales, ["revenue", "units", "returns"], "category", "count").collect()
    assert len(out) == 9
    units = {r.name: r.value for r in out if r.axis == "units"}
    assert units == {"Electronics": 132.0, "Clothing": 263.0, "Food": 640.0}
    assert {r.axis_max for r in out if r.axis == "units"} == {768.0}
    total = charts.chart_radar(sales, ["revenue", "units", "returns"]).collect()
    assert [r.name for r in total] == ["Total"] * 3
    zero = spark.createDataFrame([("a", 0, 0, 0)], "g string, x int, y int, z int")
    assert {r.axis_max for r in charts.chart_radar(zero, ["x", "y", "z"], "g").collect()} == {1.0}
    with pytest.raises(ValueError):
        charts.chart_radar(sales, ["revenue", "units"])


def test_combo(sales):
    out = charts.chart_combo(sales, "date", [("revenue", "sum"), ("units", "mean"),
                                             ("units", "count")], sort="desc", limit=1)
    assert tuples(out) == [("2024-03", 24700.0, 124.0, 3.0)]
    with pytest.raises(ValueError):
        charts.chart_combo(sales, "date", [])
