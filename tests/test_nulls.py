import pytest
from pyspark.sql import functions as F

from stratawork.functions import cleaning, nulls, scalars
from stratawork.operators import project


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, x int")


@pytest.mark.parametrize("predicate, kept", [
    (lambda: nulls.eq("x", 5), {1}), (lambda: nulls.ne("x", 5), {2, 3}),
    (lambda: ~nulls.gt("x", 5), {1, 3}), (lambda: nulls.ge("x", 6), {2}),
    (lambda: nulls.lt("x", 6), {1}), (lambda: nulls.le("x", 6), {1, 2}),
    (lambda: nulls.between("x", 5, 5), {1}), (lambda: nulls.is_in("x", [5, 7]), {1}),
    (lambda: nulls.is_in("x", [5, None]), {1, 3}), (lambda: ~nulls.is_in("x", [5]), {2, 3}),
    (lambda: nulls.is_in("x", []), set()), (lambda: nulls.gt("x", F.col("id") + 3), {1, 2}),
    (lambda: ~nulls.gt("x", F.col("id") + 3), {3}),
    (lambda: ~nulls.lt(F.lit(1), F.col("x")), {3}),
])
def test_two_valued(df, predicate, kept):
    assert {r.id for r in project.filter_rows(df, predicate()).collect()} == kept


def test_sql_text_keeps_sql_rules(df):
    assert {r.id for r in project.filter_rows(df, "x <> 5").collect()} == {2}


def test_null_mode_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 5)], "id int, x int").write.parquet(path)
    out = spark.read.parquet(path).where(nulls.ne("x", 5) & nulls.gt("id", 0)).select("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(id,0)" in pushed and "IsNull(x)" in pushed


def test_scalars(spark):
    df = spark.createDataFrame([(7, -7, 0, 2.5, "Abcdef", "12"), (None, 3, 2, 3.5, None, "x")],
                               "a int, b int, z int, h double, s string, n string")
    got = df.select(
        scalars.modulo("b", 3), scalars.floor_div("b", 2), scalars.ratio("a", "z"),
        scalars.half_even("h"), scalars.slice_text("s", 1, 3), scalars.number_or_null("n"),
        scalars.strip_lower("s"), scalars.clip("b", -5, 2), scalars.matches("s", "cd")).collect()
    assert tuple(got[0]) == (2, -4, None, 2.0, "bc", 12.0, "abcdef", -5, True)
    assert tuple(got[1]) == (0, 1, None, 4.0, None, None, None, 2, None)


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("-inf"), 2), (1.23456789, 3)],
                               "x double, n int")
    assert [tuple(r) for r in cleaning.finite_columns(df).collect()] == [
        (None, 1), (None, 2), (1.23456789, 3)]
    assert [r[0] for r in df.select(cleaning.chart_number(F.col("x"))).collect()] == [
        None, None, 1.234568]
