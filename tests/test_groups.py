import random

import pandas as pd
import pytest

from stratawork.operators import groups


@pytest.fixture
def visits(spark):
    return spark.createDataFrame(
        [("a", 1, 10, "x"), ("a", 2, None, "y"), ("a", 3, 30, None), ("b", None, 7, "z"),
         ("b", 1, 8, None), (None, 1, 1, "q")], "g string, t int, n int, s string")


def test_last_skips_missing_per_column(visits, rows):
    # a missing order value sorts last
    assert rows(groups.last_per_group(visits, "g", "t"), "g", "n", "s") == [
        ("a", 30, "y"), ("b", 7, "z")]
    assert rows(groups.first_per_group(visits, "g", "t"), "g", "n", "s") == [
        ("a", 10, "x"), ("b", 8, "z")]


def test_descending_keeps_missing_last(visits, rows):
    assert rows(groups.last_per_group(visits, "g", "t", ascending=False), "g", "n", "s") == [
        ("a", 10, "x"), ("b", 7, "z")]
    assert rows(groups.first_per_group(visits, "g", "t", ascending=False), "g", "n", "s") == [
        ("a", 30, "y"), ("b", 8, "z")]


def test_whole_row(visits, rows):
    out = groups.last_per_group(visits, "g", "t", whole_row=True)
    assert rows(out) == [("a", 3, 30, None), ("b", None, 7, "z")]


@pytest.mark.parametrize("seed", range(4))
def test_against_pandas(spark, rows, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice("abc"), i, rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "p", "q"]))
            for i in rnd.sample(range(100), 40)]
    df = spark.createDataFrame(data, "g string, t int, x double, s string").repartition(3)
    pdf = pd.DataFrame(data, columns=["g", "t", "x", "s"])
    for down in (False, True):
        for fn, pick in ((groups.last_per_group, "last"), (groups.first_per_group, "first")):
            want = getattr(pdf.sort_values("t", ascending=not down).groupby("g"), pick)()
            want = want.reset_index().astype(object)
            want = sorted(map(tuple, want.where(want.notna(), None).values))
            assert rows(fn(df, "g", "t", ascending=not down)) == want


def test_deduplicate(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 5, "d"), (None, 4, "e")],
        "k int, t int, v string")
    assert rows(groups.deduplicate(df, "k", "first", "t"), "v") == [("a",), ("c",), ("e",)]
    assert rows(groups.deduplicate(df, "k", "last", "t"), "v") == [("b",), ("c",), ("d",)]
    assert rows(groups.deduplicate(df, "k", False)) == [(2, 1, "c")]
    assert groups.deduplicate(df.union(df)).count() == 5
    assert groups.deduplicate(df.union(df), keep=False).count() == 0
    assert groups.deduplicate(df.limit(0), "k", "first", "t").count() == 0
    with pytest.raises(ValueError):
        groups.deduplicate(df, "k")
    with pytest.raises(KeyError):
        groups.deduplicate(df, "nope", "first", "t")


def test_ties_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(1, 1, i) for i in range(20)], "k int, t int, v int")
    for keep, v in (("first", 0), ("last", 19)):
        for n in (1, 5):
            assert rows(groups.deduplicate(df.repartition(n), "k", keep, "t")) == [(1, 1, v)]


@pytest.mark.parametrize("parts", [1, 7])
def test_flag_duplicates(spark, parts):
    """One unmarked row per key, also when a key is hot or rows are copies."""
    data = [(0, i % 3) for i in range(300)] + [(k, 0) for k in range(1, 50)] + [(None, 1)] * 3
    df = spark.createDataFrame(data, "k int, v int").repartition(parts)
    out = groups.flag_duplicates(df, "k", "v").collect()
    assert len(out) == len(data)
    first = [(r.k, r.v) for r in out if not r.is_duplicate]
    assert sorted(first, key=str) == sorted([(0, 0), (None, 1)] + [(k, 0) for k in range(1, 50)],
                                            key=str)
    whole = groups.flag_duplicates(df).where("NOT is_duplicate")
    assert whole.count() == 3 + 49 + 1
