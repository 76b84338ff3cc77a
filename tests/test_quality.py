import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratawork.operators import quality
from stratawork.operators.quality import Expectation as E


def by_position(df):
    return [r.asDict() for r in df.orderBy("position").collect()]


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [(1, 150, "SPEDITO"), (2, 1000, "IN_CORSO"), (3, 300, "ERROR"), (4, 250, "SPEDITO"),
         (5, 50, "ANNULLATO")], "id_prodotto bigint, prezzo bigint, stato string")


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame([(i, f"p{i}") for i in range(1, 5)], "id bigint, nome string")


def test_orders_suite(orders, catalogue):
    results = quality.run_suite([
        E("between", {"x": "ordini.prezzo"}, {"min_val": 10, "max_val": 1000}),
        E("mean", {"x": "ordini.prezzo"}, {"min_avg": 100, "max_avg": 500}),
        E("in_set", {"x": "ordini.stato"},
          {"allowed_values": ["SPEDITO", "IN_CORSO", "ERRORE", "ANNULLATO"]}),
        E("in_other", {"x": "ordini.id_prodotto", "y": "catalogo.id"}),
    ], {"ordini": orders, "catalogo": catalogue})
    got = by_position(results)
    assert [(r["score"], r["success"]) for r in got] == [
        (1.0, True), (1.0, True), (0.8, False), (0.8, False)]
    assert [r["failed"] for r in got] == [0, None, 1, 1]
    assert quality.summarize(results).first().asDict() == {
        "total": 4, "passed": 2, "failed": 2, "score": 0.5, "success": False}


def test_fiscal_code(spark):
    data = [("RSSMRA80A01H501U", dt.datetime(1980, 1, 1), "M"),
            ("VRDLGI92B55F205Z", dt.datetime(1992, 2, 15), "F"),
            ("BNCPLA75C01L219X", dt.datetime(1975, 3, 15), "M"),
            ("NRIGNN88T10A944W", dt.datetime(1988, 5, 10), "M"),
            ("NRIGNN88EXXA944W", dt.datetime(1988, 5, 10), "M")]
    df = spark.createDataFrame(data, "cf string, nascita timestamp, genere string")
    use = E("fiscal_code", {"fiscalcode": "u.cf", "birthdate": "u.nascita", "gender": "u.genere"})
    assert by_position(quality.run_suite([use], {"u": df}))[0]["score"] == 0.4
    bad = quality.failed_rows(use, {"u": df})
    assert {r.cf[:6] for r in bad.collect()} == {"BNCPLA", "NRIGNN"} and bad.count() == 3


EIGHT = [
    E("not_null", {"x": "this.product"}), E("not_null", {"x": "this.revenue"}),
    E("between", {"x": "this.quantity"}, {"min_val": 1, "max_val": 100}),
    E("unique", {"x": "this.product"}),
    E("in_set", {"x": "this.category"}, {"allowed_values": ["A", "B", "C"]}),
    E("type", {"x": "this.revenue"}, {"target_type": "float"}),
    E("length", {"x": "this.product"}, {"min_len": 1, "max_len": 20}),
    E("mean", {"x": "this.revenue"}, {"min_avg": 0, "max_avg": 10000}),
]
SALES = "product string, quantity bigint, revenue double, category string"


def test_clean_sales(spark):
    df = spark.createDataFrame([(f"p{i}", i + 1, 10.0 * i, "ABC"[i % 3]) for i in range(5)], SALES)
    assert quality.summarize(quality.run_suite(EIGHT, {"this": df})).first().asDict() == {
        "total": 8, "passed": 8, "failed": 0, "score": 1.0, "success": True}


def test_dirty_sales(spark):
    df = spark.createDataFrame(
        [("p1", 1, 10.0, "A"), ("p1", 150, 20.0, "B"), ("p2", 3, None, "C"), ("p3", 4, 5.0, "X")],
        SALES)
    results = quality.run_suite(EIGHT, {"this": df})
    assert [r["score"] for r in by_position(results)] == [1, .75, .75, .75, .75, 1, 1, 1]
    summary = quality.summarize(results).first()
    assert (summary.score, summary.success) == (0.5, False)


def test_missing_values_fail(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n int, s string")
    uses = [E("between", {"x": "d.n"}, {"min_val": 0, "max_val": 9}),
            E("in_set", {"x": "d.s"}, {"allowed_values": ["a"]}),
            E("in_set", {"x": "d.s"}, {"allowed_values": ["a", None]}),
            E("regex", {"x": "d.s"}, {"pattern": "a"}),
            E("length", {"x": "d.s"}, {"min_len": 0, "max_len": 9}),
            E("pair_greater", {"a": "d.n", "b": "d.n"}),
            E("type", {"x": "d.n"}, {"target_type": "int"}),
            E("type", {"x": "d.n"}, {"target_type": "str"}),
            E("unique", {"x": "d.s"})]
    assert [r["score"] for r in by_position(quality.run_suite(uses, {"d": df}))] == [
        .5, .5, 1, .5, .5, 0, .5, 0, 1]


def test_tolerance_is_the_least_passing_share(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    uses = [E("not_null", {"x": "d.n"}, tolerance=t) for t in (0.5, 0.51)]
    assert [r["success"] for r in by_position(quality.run_suite(uses, {"d": df}))] == [True, False]


def test_errors_do_not_stop_the_suite(spark):
    df = spark.createDataFrame([(1,)], "id bigint")
    rules = {"odd": quality.custom_rule("row", ["x"], "{x} LIKE"),
             "text": quality.custom_rule("row", ["x"], "{x} + 1")}
    uses = [E("not_null", {"x": "d.nope"}), E("nope", {"x": "d.id"}), E("between", {"x": "d.id"}),
            E("not_null", {"x": "id"}), E("not_null", {}), E("not_null", {"x": "e.id"}),
            E("odd", {"x": "d.id"}), E("text", {"x": "d.id"}), E("not_null", {"x": "d.id"}),
            E("pair_greater", {"a": "d.id", "b": "f.id"})]
    got = by_position(quality.run_suite(uses, {"d": df, "f": df}, rules))
    assert [r["success"] for r in got] == [False] * 8 + [True, False]
    assert all(r["error"] for r in got if not r["success"])


def test_empty_table_fails(spark):
    df = spark.createDataFrame([], "n int")
    uses = [E("not_null", {"x": "d.n"}), E("unique", {"x": "d.n"}),
            E("in_other", {"x": "d.n", "y": "d.n"})]
    assert [(r["score"], r["success"]) for r in by_position(quality.run_suite(uses, {"d": df}))] \
        == [(None, False)] * 3


def test_custom_rules(spark):
    df = spark.createDataFrame([("it's", 1), ("b", 2)], "s string, n int")
    rules = {
        "named": quality.custom_rule("row", ["x"], "{x} IN {names}", ["names"]),
        "small": quality.custom_rule("aggregate", ["x"], "max({x}) < {top}", ["top"]),
        "even": quality.custom_rule("row", ["x"], lambda x: x % 2 == 0)}
    uses = [E("named", {"x": "d.s"}, {"names": ["it's", "z"]}), E("small", {"x": "d.n"}, {"top": 3}),
            E("even", {"x": "d.n"})]
    assert [r["score"] for r in by_position(quality.run_suite(uses, {"d": df}, rules))] == [.5, 1, .5]


def test_failed_rows_have_the_failing_share(spark):
    df = spark.createDataFrame([(i % 4, None if i % 3 == 0 else i) for i in range(24)],
                               "k int, v int")
    other = spark.createDataFrame([(1,), (2,)], "k int")
    for use in (E("not_null", {"x": "d.v"}), E("unique", {"x": "d.k"}),
                E("compound_unique", {"a": "d.k", "b": "d.v"}),
                E("in_other", {"x": "d.k", "y": "o.k"})):
        data = {"d": df, "o": other}
        result = quality.run_suite([use], data).first()
        assert quality.failed_rows(use, data).count() == result.failed
        assert result.score == pytest.approx(1 - result.failed / 24, abs=1e-4)


def test_one_pass_for_all_row_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("v", F.col("id")).write.parquet(path)
    df = spark.read.parquet(path)
    uses = [E("not_null", {"x": "d.id"}), E("between", {"x": "d.v"}, {"min_val": 0, "max_val": 5}),
            E("mean", {"x": "d.v"}, {"min_avg": 0, "max_avg": 5})]
    plan = quality.run_suite(uses, {"d": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_nan_is_missing_in_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (nan, 2.0), (None, 3.0), (4.0, nan)], "x double, y double")
    rules = {"text": quality.custom_rule("row", ["x"], "{x} > 0")}
    uses = [E("not_null", {"x": "d.x"}), E("between", {"x": "d.x"}, {"min_val": 0, "max_val": 9}),
            E("pair_greater", {"a": "d.y", "b": "d.x"}), E("text", {"x": "d.x"}),
            E("mean", {"x": "d.x"}, {"min_avg": 2.5, "max_avg": 2.5}),
            E("type", {"x": "d.x"}, {"target_type": "float"})]
    assert [r["score"] for r in by_position(quality.run_suite(uses, {"d": df}, rules))] == [.5, .5, 0, .5, 1, 1]
    assert quality.failed_rows(uses[0], {"d": df}).count() == 2


def test_a_rule_that_fails_on_the_data_is_one_failed_row(spark):
    df = spark.createDataFrame([(1, "x"), (2, "7")], "id int, t string")
    rules = {"cast": quality.custom_rule("row", ["t"], "cast({t} AS int) > 0")}
    uses = [E("not_null", {"x": "d.id"}), E("cast", {"t": "d.t"}),
            E("unique", {"x": "d.id"}), E("not_null", {"x": "d.nope"})]
    got = by_position(quality.score_suite(uses, {"d": df}, rules))
    assert [r["success"] for r in got] == [True, False, True, False]
    assert "CAST_INVALID_INPUT" in got[1]["error"] and "nope" in got[3]["error"]
    uses.pop(1)
    assert [r["success"] for r in by_position(quality.score_suite(uses, {"d": df}))] == [True, True, False]


MIXED = [("not_null", {"x": "d.k"}, {}), ("mean", {"x": "d.v"}, {"min_avg": 0, "max_avg": 100}),
         ("unique", {"x": "d.k"}, {}), ("unique", {"x": "d.v"}, {}), ("unique", {"x": "d.k"}, {}),
         ("compound_unique", {"a": "d.k", "b": "d.v"}, {}), ("in_other", {"x": "d.k", "y": "o.id"}, {}),
         ("in_other", {"x": "d.k", "y": "p.id"}, {}), ("in_other", {"x": "d.t", "y": "p.t"}, {}),
         ("in_other", {"x": "d.k", "y": "d.k"}, {}), ("rows", {"x": "d.k"}, {"most": 6}),
         ("between", {"x": "d.v"}, {"min_val": 0, "max_val": 2})]


@pytest.mark.parametrize("n", [0, 1, 9])
def test_a_mixed_suite_equals_its_rules_alone(spark, n):
    nan = float("nan")
    data = [(1, 1.0, "a"), (1, 1.0, "a"), (2, nan, None), (None, None, "b"), (None, 2.0, "zz"), (3, 0.0, "c"),
            (4, -0.0, "c"), (5, nan, None), (1, 3.0, "x")][:n]
    d = spark.createDataFrame(data, "k int, v double, t string")
    o = spark.createDataFrame([(1,), (1,), (None,), (7,)], "id bigint")
    p = spark.createDataFrame([(3, "a"), (4, None)], "id smallint, t string")
    rules = {"rows": quality.custom_rule("aggregate", ["x"], "count(*) <= {most}", ["most"])}
    uses = [E(*m) for m in MIXED]
    tables = {"d": d, "o": o, "p": p}
    got = {r.position: tuple(r)[1:] for r in quality.run_suite(uses, tables, rules).collect()}
    keys = [(r[0], r[1]) for r in data], [r[0] for r in data]

    def same(v):
        return "nan" if v is not None and v != v else v

    for i, use in enumerate(uses):
        if use.rule_id in ("not_null", "mean", "between", "rows"):
            assert got[i] == tuple(quality.run_suite([use], tables, rules).first())[1:], use
    known = {"o": {1, None, 7}, "p": {3, 4}, "d": set(keys[1])}
    passed = {2: len(set(keys[1])), 3: len({same(r[1]) for r in data}), 4: len(set(keys[1])),
              5: len({(a, same(b)) for a, b in keys[0]}), 6: sum(k in known["o"] for k in keys[1]),
              7: sum(k in known["p"] for k in keys[1]), 8: sum(r[2] in {"a", None} for r in data), 9: n}
    for i, ok in passed.items():
        assert got[i][1] == (round(ok / n, 4) if n else None), uses[i]
        assert got[i][4:6] == (n, n - ok)


def test_a_mixed_suite_reads_its_dataset_once(spark):
    import __spark_entry__ as entry
    from tests.conftest import DATA
    text = entry.queries()["dq_suite"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_returnflag" in line for line in text.splitlines()) == 1


def test_failing_rows_name_all_their_rules(spark):
    data = [(1, 1.0), (1, 5.0), (2, None), (3, 0.5), (None, 9.0)]
    d = spark.createDataFrame(data, "k int, v double")
    o = spark.createDataFrame([(1,), (3,)], "id int")
    uses = [E("not_null", {"x": "d.k"}), E("between", {"x": "d.v"}, {"min_val": 0, "max_val": 4}),
            E("unique", {"x": "d.k"}), E("in_other", {"x": "d.k", "y": "o.id"}),
            E("mean", {"x": "d.v"}, {"min_avg": 50, "max_avg": 60})]
    out = quality.failing_rows(uses, {"d": d, "o": o})
    assert out.columns == ["k", "v", "failed"]
    got = sorted(((r.k, r.v), tuple(r.failed)) for r in out.where("k IS NULL OR k != 1").collect() if r.k)
    assert got == [((2, None), (1, 3))]
    assert [tuple(r.failed) for r in out.where("k IS NULL").collect()] == [(0, 1, 3)]
    # One of the two rows with key 1 is a duplicate, whichever it is.
    ones = {r.v: tuple(r.failed) for r in out.where("k = 1").collect()}
    assert ones in ({5.0: (1, 2)}, {1.0: (2,), 5.0: (1,)})
    assert quality.failing_rows(uses[:2], {"d": d.limit(0)}).count() == 0
    assert quality.failing_rows(uses[4:], {"d": d}).count() == 0
    with pytest.raises(ValueError):
        quality.failing_rows([uses[0], E("not_null", {"x": "o.id"})], {"d": d, "o": o})
