import random

import pandas as pd
import pytest

from stratawork.operators import gaps

ALIAS = {"day": ("D", "%Y-%m-%d"), "week": ("W-MON", "%Y-%m-%d"), "month": ("MS", "%Y-%m"),
         "year": ("YS", "%Y")}
STRATEGIES = ["null", "zero", "ffill", "bfill", "interpolate"]


def brute(pdf, frequency, strategy, start, end):
    """Plain pandas, one group at a time."""
    alias, pattern = ALIAS[frequency]
    day = pd.to_datetime(pdf["date"])
    calendar = pd.date_range(start or day.min(), end or day.max(), freq=alias)
    out = []
    for g, part in pdf.assign(date=day).groupby("g"):
        s = part.set_index("date")[["x", "s"]].reindex(calendar)
        if strategy == "zero":
            s["x"], s["s"] = s["x"].fillna(0), s["s"].fillna("")
        elif strategy in ("ffill", "bfill"):
            s = getattr(s, strategy)()
        elif strategy == "interpolate":
            s["x"] = s["x"].interpolate(limit_direction="both")
        for d, x, t in zip(s.index, s["x"], s["s"]):
            out.append((g, d.strftime(pattern), None if pd.isna(x) else round(x, 9),
                        None if pd.isna(t) else t))
    return sorted(out, key=str)


def sample(seed, frequency):
    rnd = random.Random(seed)
    days = pd.date_range("2023-11-20", "2025-02-10", freq=ALIAS[frequency][0])
    out = []
    for g in "abc":
        for d in rnd.sample(list(days), min(len(days), rnd.choice([1, 5, 12]))):
            out.append((g, d.strftime("%Y-%m-%d"), rnd.choice([None, rnd.random() * 10]),
                        rnd.choice([None, "p", "q"])))
    out.append(("off", "2024-02-29", 1.0, "z"))  # a Thursday, not a month start
    return out


@pytest.mark.parametrize("frequency", list(ALIAS))
@pytest.mark.parametrize("strategy", STRATEGIES)
def test_against_pandas(spark, frequency, strategy):
    bounds = [(None, None), ("2023-10-05", "2025-03-03"), ("2024-03-06", "2024-09-20")]
    for seed, (start, end) in enumerate(bounds if strategy == "interpolate" else bounds[:1]):
        data = sample(seed, frequency)
        if frequency in ("month", "year"):  # dates are cut, so all are on the calendar
            data = [r for r in data if r[0] != "off"]
        pdf = pd.DataFrame(data, columns=["g", "date", "x", "s"])
        df = spark.createDataFrame(data, "g string, date string, x double, s string")
        out = gaps.reindex_series(df, "date", "g", frequency, start, end, strategy)
        got = [(r.g, r.date, None if r.x is None else round(r.x, 9), r.s) for r in out.collect()]
        assert sorted(got, key=str) == brute(pdf, frequency, strategy, start, end)


def test_interpolation_by_position(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}", v) for i, v in
                                [(1, None), (2, 1.0), (5, 4.0), (6, None)]], "date string, v double")
    out = gaps.reindex_series(df, fill="interpolate").orderBy("date").collect()
    assert [r.v for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_strategies_per_column(spark):
    df = spark.createDataFrame([("2024-01-01", 1, "a"), ("2024-01-03", None, None)],
                               "date string, n int, s string")
    out = gaps.reindex_series(df, fill={"strategy": "ffill", "columns": {"n": "zero"}})
    assert [tuple(r) for r in out.orderBy("date").collect()] == [
        ("2024-01-01", 1, "a"), ("2024-01-02", 0, "a"), ("2024-01-03", 0, "a")]


def test_rows_of_one_period_all_stay(spark, rows):
    df = spark.createDataFrame(
        [("2024-01-01", 5), ("2024-01-02", None), ("2024-01-02", 7), ("2024-01-04", None)],
        "date string, n int")
    out = rows(gaps.reindex_series(df, fill="ffill"))
    # within a period a known value comes first
    assert out == [("2024-01-01", 5), ("2024-01-02", 7), ("2024-01-02", 7), ("2024-01-03", 7),
                   ("2024-01-04", 7)]


def test_tie_break_orders_rows_of_a_period(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 9), ("2024-01-01", 2, 5), ("2024-01-02", 3, None)],
                               "date string, k int, n int")
    out = gaps.reindex_series(df, fill={"columns": {"n": "ffill"}}, tie_break="k")
    assert out.where("date = '2024-01-02'").first().n == 5


def test_timestamps_are_cut_to_days(spark, rows):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS date, 1 AS n "
                   "UNION ALL SELECT TIMESTAMP_NTZ '2024-01-03 23:59:59', 2")
    assert rows(gaps.reindex_series(df)) == [
        ("2024-01-01", 1), ("2024-01-02", None), ("2024-01-03", 2)]


def test_missing_group_key_is_a_group(spark, rows):
    df = spark.createDataFrame([(None, "2024-01-01", 1), (None, "2024-01-03", 3)],
                               "g string, date string, n int")
    assert [r[2] for r in rows(gaps.reindex_series(df, group_by="g", fill="ffill"))] == [1, 1, 3]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, date string, n int")
    assert gaps.reindex_series(df, group_by="g", fill="ffill").count() == 0
    full = gaps.reindex_series(df.drop("g"), start="2024-01-01", end="2024-01-05", fill="ffill")
    assert full.count() == 5


def test_errors(spark):
    df = spark.createDataFrame([("2024-01-01", 1)], "date string, n int")
    for kwargs in ({"frequency": "hour"}, {"group_by": "g"}, {"date_column": "d"},
                   {"fill": "magic"}):
        with pytest.raises(ValueError):
            gaps.reindex_series(df, **kwargs)


def test_calendar_grid(spark):
    from pyspark.sql import functions as F
    out = gaps.calendar_grid(spark.range(3), F.lit("2024-01-01").cast("date"),
                             F.lit("2024-01-31").cast("date"), "week")
    assert out.count() == 15
