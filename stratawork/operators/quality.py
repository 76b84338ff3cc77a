"""Data-quality rules.

A rule binds its inputs to ``dataset.column`` names and takes parameters. Row
rules yield a boolean per row and score the share of rows that pass; a missing
value in a comparison fails. Aggregate rules yield one boolean. A rule succeeds
when ``score >= tolerance`` (the minimum passing share).

``run_suite`` reads each dataset once for all its rules. Row and aggregate rules alone
are one aggregate. With uniqueness and membership rules each row is expanded to one
(rule, key) pair per such rule, and these are counted (partially before the shuffle, so
a hot value is one row afterwards); row rules ride along as the pattern of those that
hold. ``Watch`` measures row and aggregate rules while the rows are written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import is_floating, known_value, truth
from ..functions.scalars import lookup, slice_text
from .groups import flag_duplicates
from .joins import anti_join, with_membership


@dataclass(frozen=True)
class Rule:
    """Definition of a rule. ``check`` gets the bound columns and parameters by
    name, plus ``types`` (name -> DataType) when ``needs_types``; or it is
    Spark SQL text with ``{name}`` for inputs and parameters."""

    kind: str  # row | aggregate | unique | in_other
    inputs: tuple[str, ...]
    params: tuple[str, ...] = ()
    check: Callable[..., Column] | str | None = None
    needs_types: bool = False


@dataclass(frozen=True)
class Expectation:
    """Use of a rule: ``inputs`` map placeholders to ``dataset.column``."""

    rule_id: str
    inputs: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)
    tolerance: float = 1.0


# Month letters of the fiscal code and the day offset by gender.
MONTH_LETTERS = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "H": 6,
                 "L": 7, "M": 8, "P": 9, "R": 10, "S": 11, "T": 12}
GENDER_DAY_OFFSET = {"M": 0, "F": 40}


def _fiscal_code(fiscalcode: Column, birthdate: Column, gender: Column) -> Column:
    """Year, month letter and day (+40 for women) agree with the birth date.
    Unreadable digits fail the row."""
    day = slice_text(fiscalcode, 9, 11).try_cast("int")
    return (
        (slice_text(fiscalcode, 6, 8) == F.date_format(birthdate, "yy"))
        & (lookup(slice_text(fiscalcode, 8, 9), MONTH_LETTERS) == F.month(birthdate))
        & (day == F.dayofmonth(birthdate) + lookup(gender, GENDER_DAY_OFFSET)))


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "Timestamp"
    names = {T.StringType: "str", T.BooleanType: "bool", T.DateType: "date",
             T.DecimalType: "Decimal", T.BinaryType: "bytes"}
    return next((n for t, n in names.items() if isinstance(kind, t)), kind.typeName())


def _of_type(x: Column, target_type: str, types: Mapping[str, T.DataType]) -> Column:
    """All known values of a column share its type. A missing float is NaN,
    hence still a float; other missing values have no type and fail."""
    name = _type_name(types["x"])
    if name != target_type:
        return F.lit(False)
    return F.lit(True) if name == "float" else x.isNotNull()


def _in_set(x: Column, allowed_values: list) -> Column:
    known = [v for v in allowed_values if v is not None]
    hit = x.isin(known) if known else F.lit(False)
    return hit | x.isNull() if len(known) < len(allowed_values) else hit


RULES: dict[str, Rule] = {
    "not_null": Rule("row", ("x",), (), lambda x: x.isNotNull()),
    "between": Rule("row", ("x",), ("min_val", "max_val"),
                    lambda x, min_val, max_val: x.between(min_val, max_val)),
    "in_set": Rule("row", ("x",), ("allowed_values",), _in_set),
    "regex": Rule("row", ("x",), ("pattern",), lambda x, pattern: x.rlike(pattern)),
    "type": Rule("row", ("x",), ("target_type",), _of_type, needs_types=True),
    "length": Rule("row", ("x",), ("min_len", "max_len"),
                   lambda x, min_len, max_len: F.length(x).between(min_len, max_len)),
    "pair_greater": Rule("row", ("a", "b"), (), lambda a, b: a > b),
    "fiscal_code": Rule("row", ("fiscalcode", "birthdate", "gender"), (), _fiscal_code),
    "mean": Rule("aggregate", ("x",), ("min_avg", "max_avg"),
                 lambda x, min_avg, max_avg: F.avg(x).between(min_avg, max_avg)),
    "unique": Rule("unique", ("x",)),
    "compound_unique": Rule("unique", ("a", "b")),
    "in_other": Rule("in_other", ("x", "y")),
}


def custom_rule(kind: str, inputs: list[str], check: str | Callable[..., Column],
                params: list[str] = ()) -> Rule:
    """A rule of your own: ``kind`` row (boolean per row) or aggregate (one
    boolean). ``check`` is a function of Columns or Spark SQL text with
    ``{name}`` for inputs and parameters."""
    if kind not in ("row", "aggregate"):
        raise ValueError(f"kind must be 'row' or 'aggregate', got '{kind}'")
    return Rule(kind, tuple(inputs), tuple(params), check)


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class _Bound:
    position: int
    use: Expectation
    rule: Rule
    dataset: str
    columns: dict[str, str]
    other: str | None = None


def _bind(position: int, use: Expectation, datasets: Mapping[str, DataFrame],
          rules: Mapping[str, Rule]) -> _Bound:
    rule = rules.get(use.rule_id)
    if rule is None:
        raise KeyError(f"rule '{use.rule_id}' not found")
    where: dict[str, str] = {}
    columns: dict[str, str] = {}
    for name in rule.inputs:
        target = use.inputs.get(name)
        if not target:
            raise KeyError(f"no input given for '{name}'")
        dataset, dot, column = target.partition(".")
        if not dot:
            raise ValueError(f"input '{target}' must be 'dataset.column'")
        if dataset not in datasets:
            raise KeyError(f"dataset '{dataset}' not found (available: {list(datasets)})")
        if column not in datasets[dataset].columns:
            raise KeyError(f"column '{column}' not found in dataset '{dataset}'")
        where[name], columns[name] = dataset, column
    for name in rule.params:
        if name not in use.params:
            raise KeyError(f"required parameter missing: '{name}'")
    home = where[rule.inputs[0]]
    if rule.kind != "in_other" and set(where.values()) != {home}:
        raise ValueError("inputs of one rule must come from one dataset")
    return _Bound(position, use, rule, home, columns, where.get("y"))


def predicate(rule: Rule, df: DataFrame, columns: Mapping[str, str],
              params: Mapping[str, Any]) -> Column:
    """The boolean (row or aggregate) expression of a rule on ``df``. In floating
    columns NaN is missing."""
    if isinstance(rule.check, str):
        names = {n: f"nullif(`{c}`, double('NaN'))" if is_floating(df, c) else f"`{c}`"
                 for n, c in columns.items()}
        return F.expr(rule.check.format_map(
            names | {p: _literal(params[p]) for p in rule.params}))
    bound: dict[str, Any] = {n: known_value(df, c) for n, c in columns.items()}
    bound |= {p: params[p] for p in rule.params}
    if rule.needs_types:
        bound["types"] = {n: df.schema[c].dataType for n, c in columns.items()}
    return rule.check(**bound)


RESULT = "position int, rule_id string, score double, tolerance double, " \
         "success boolean, total bigint, failed bigint, error string"


def _result(b: _Bound, score: Column, total: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(b.position).alias("position"), F.lit(b.use.rule_id).alias("rule_id"),
        F.round(score, 4).alias("score"), F.lit(float(b.use.tolerance)).alias("tolerance"),
        F.coalesce(score >= F.lit(float(b.use.tolerance)), F.lit(False)).alias("success"),
        total.cast("bigint").alias("total"), failed.cast("bigint").alias("failed"),
        F.lit(None).cast("string").alias("error"))


def _measures(df: DataFrame, rules: list[_Bound]) -> list[Column]:
    """Aggregates that row and aggregate rules come to, and the number of rows."""
    out: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for b in rules:
        check = truth(predicate(b.rule, df, b.columns, b.use.params))
        out.append((F.count_if(check) if b.rule.kind == "row" else check).alias(f"__r{b.position}"))
    return out


def _judged(measured: DataFrame, rules: list[_Bound]) -> DataFrame:
    rows = F.col("__rows")

    def of(b: _Bound) -> Column:
        got = F.col(f"__r{b.position}")
        if b.rule.kind == "row":
            return _result(b, F.try_divide(got, rows), rows, rows - got)
        return _result(b, got.cast("double"), rows, F.lit(None))
    return measured.select(F.inline(F.array(*[of(b) for b in rules])))


def _common_type(df: DataFrame, x: str, other: DataFrame, y: str) -> T.DataType:
    """The type in which two columns are compared."""
    both = [F.lit(None).cast(d.schema[c].dataType) for d, c in ((df, x), (other, y))]
    return df.sparkSession.range(0).select(F.coalesce(*both).alias("k")).schema["k"].dataType


def _counted(df: DataFrame, rules: list[_Bound], datasets: Mapping[str, DataFrame]) -> DataFrame:
    """All rules of a dataset from one count per (rule, key). Set 0 of the expanded
    rows has no key, set 1 the pattern of row rules, the others the columns of one
    uniqueness or membership rule. Known values of other datasets join in as rows
    that count nothing."""
    rows, keyed = ([b for b in rules if b.rule.kind in kinds] for kinds in (("row",), ("unique", "in_other")))
    whole = [b for b in rules if b.rule.kind == "aggregate"]
    checks = [truth(predicate(b.rule, df, b.columns, b.use.params)) for b in rows]
    # The type of a membership rule's key is that in which it is compared.
    kinds: list[T.DataType] = [T.ArrayType(T.BooleanType())]
    parts: dict[tuple, int] = {}
    for b in keyed:
        for name, c in b.columns.items():
            if b.rule.kind == "unique" or name == "x":
                kind = df.schema[c].dataType if b.rule.kind == "unique" else \
                    _common_type(df, c, datasets[b.other], b.columns["y"])
                if (c, kind.simpleString()) not in parts:
                    parts[c, kind.simpleString()] = len(kinds)
                    kinds.append(kind)

    def keys_of(b: _Bound) -> dict[int, str]:
        if b.rule.kind == "unique":
            return {parts[c, df.schema[c].dataType.simpleString()]: c for c in b.columns.values()}
        kind = _common_type(df, b.columns["x"], datasets[b.other], b.columns["y"])
        return {parts[b.columns["x"], kind.simpleString()]: b.columns["x"]}

    def part(number: int, cells: Mapping[int, Column]) -> Column:
        return F.struct(F.lit(number).alias("s"), *[
            cells.get(i, F.lit(None)).cast(kind).alias(f"k{i}") for i, kind in enumerate(kinds)])

    sets = [{0: F.array(*checks).cast(kinds[0])}] + [{i: F.col(f"`{c}`") for i, c in keys_of(b).items()} for b in keyed]
    sets = ([{}] if whole else []) + [s for i, s in enumerate(sets) if i or rows]
    number = {b.position: 2 + i for i, b in enumerate(keyed)}
    numbers = ([0] if whole else []) + ([1] if rows else []) + list(number.values())
    inputs = {c for b in whole for c in b.columns.values()}
    expanded = df.select(*[F.col(f"`{c}`") for c in df.columns if c in inputs],
                         F.explode(F.array(*[part(n, s) for n, s in zip(numbers, sets)])).alias("__e"))
    expanded = expanded.withColumn("__n", F.lit(1)).withColumn("__hit", F.lit(False))
    for b in keyed:
        if b.rule.kind == "in_other":
            known = datasets[b.other].select(F.col(f"`{b.columns['y']}`").alias("y")).distinct()
            known = known.select(part(number[b.position], {i: F.col("y") for i in keys_of(b)}).alias("__e"),
                                 F.lit(0).alias("__n"), F.lit(True).alias("__hit"))
            expanded = expanded.unionByName(known, allowMissingColumns=True)
    fields = ["s", *(f"k{i}" for i in range(len(kinds)))]
    counts = expanded.groupBy(*[F.col(f"__e.{f}").alias(f) for f in fields]).agg(
        F.sum("__n").alias("n"), F.bool_or("__hit").alias("hit"),
        *[F.when(F.col("s") == 0, truth(predicate(b.rule, df, b.columns, b.use.params))).alias(f"w{b.position}")
          for b in whole])

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))

    there = (F.col("s") == min(numbers)) & (F.col("n") > 0)
    measures = [total(there).alias("__rows")]
    for i, b in enumerate(rows):
        measures.append(total((F.col("s") == 1) & F.col("k0")[i]).alias(f"__r{b.position}"))
    for b in whole:
        # Without rows there is no set: the check on nothing, which reads nothing.
        check = truth(predicate(b.rule, df, b.columns, b.use.params))
        measures.append(F.coalesce(F.bool_or(f"w{b.position}"), df.limit(0).agg(check).scalar()).alias(f"__r{b.position}"))
    for b in keyed:
        own = (F.col("s") == number[b.position]) & (F.col("n") > 0)
        measures.append((F.count_if(own) if b.rule.kind == "unique" else total(own & F.col("hit"))).alias(f"__r{b.position}"))

    n = F.col("__rows")

    def of(b: _Bound) -> Column:
        got = F.col(f"__r{b.position}")
        if b.rule.kind == "aggregate":
            return _result(b, got.cast("double"), n, F.lit(None))
        return _result(b, F.try_divide(got, n), n, n - got)
    return counts.agg(*measures).select(F.inline(F.array(*[of(b) for b in rules])))


def _scores(rules: list[_Bound], datasets: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Results of bound rules, one reading per dataset."""
    out = []
    for name in dict.fromkeys(b.dataset for b in rules):
        own = [b for b in rules if b.dataset == name]
        if all(b.rule.kind in ("row", "aggregate") for b in own):
            out.append(_judged(datasets[name].agg(*_measures(datasets[name], own)), own))
        else:
            out.append(_counted(datasets[name], own, datasets))
    return out


def _arranged(expectations: list[Expectation], datasets: Mapping[str, DataFrame],
              rules: Mapping[str, Rule] | None) -> tuple[list[_Bound], list[tuple]]:
    """Bound expectations, and result rows of those that cannot be set up."""
    bound: list[_Bound] = []
    errors: list[tuple] = []
    for i, use in enumerate(expectations):
        try:
            b = _bind(i, use, datasets, {**RULES, **(rules or {})})
            df = datasets[b.dataset]
            if b.rule.kind in ("row", "aggregate"):
                check = truth(predicate(b.rule, df, b.columns, b.use.params))
                (df.agg if b.rule.kind == "aggregate" else df.select)(check)  # analysed, not run
            elif b.rule.kind == "in_other":
                _common_type(df, b.columns["x"], datasets[b.other], b.columns["y"])
            bound.append(b)
        except (KeyError, ValueError, TypeError, AnalysisException) as e:
            message = str(e.args[0]) if isinstance(e, KeyError) else str(e)
            errors.append((i, use.rule_id, None, float(use.tolerance), False, None, None, message))
    return bound, errors


def _all(spark: SparkSession, parts: list[DataFrame], errors: list[tuple]) -> DataFrame:
    return reduce(DataFrame.unionByName, [*parts, *([spark.createDataFrame(errors, RESULT)] if errors else [])])


def run_suite(expectations: list[Expectation], datasets: Mapping[str, DataFrame],
              rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """One row per expectation: score, success and counts. An expectation that
    cannot be set up (unknown rule, column or parameter, a formula that does
    not fit the column types) gives a failed row with the message; the others
    still run. Lazy: nothing is read before an action, and each dataset is read once
    (and once more where it holds the known values of another's rule)."""
    if not expectations:
        raise ValueError("the suite is empty")
    bound, errors = _arranged(expectations, datasets, rules)
    spark = next(iter(datasets.values())).sparkSession if datasets else SparkSession.getActiveSession()
    return _all(spark, _scores(bound, datasets), errors)


class Watch:
    """Row and aggregate rules of a dataset, and other aggregates, measured while its
    rows pass on their way to a file. Other rules need the whole dataset and read what
    was written."""

    def __init__(self, expectations: list[Expectation], df: DataFrame, name: str = "this",
                 rules: Mapping[str, Rule] | None = None, more: list[Column] = ()):
        self.uses, self.df, self.name, self.more = list(expectations), df, name, list(more)
        bound, self.errors = _arranged(self.uses, {name: df}, rules)
        self.passing = [b for b in bound if b.rule.kind in ("row", "aggregate")]
        self.others = [b for b in bound if b not in self.passing]
        self.seen = Observation()

    @property
    def measures_rules(self) -> bool:
        return bool(self.passing)

    def watched(self) -> DataFrame:
        """The rows, to be written as they are."""
        return self.df.observe(self.seen, *_measures(self.df, self.passing), *self.more)

    def rows(self) -> int:
        """How many rows passed."""
        return self.seen.get["__rows"]

    def complete(self, n_rows: int | None) -> bool:
        """Whether each of ``n_rows`` rows was measured once. A task that ran again may
        have counted twice; nothing is measured where there are no rows."""
        return bool(n_rows) and self.rows() == n_rows

    def covers(self, expectations: list[Expectation], n_rows: int | None) -> bool:
        """Whether just these expectations were measured, on all rows."""
        return self.measures_rules and self.uses == list(expectations) and self.complete(n_rows)

    def results(self, written: DataFrame) -> DataFrame:
        """As ``run_suite`` on what was written."""
        spark, got = written.sparkSession, self.seen.get
        own = ["__rows", *(f"__r{b.position}" for b in self.passing)]
        measured = spark.range(0, 1, 1, 1).select(*[F.lit(got[n]).alias(n) for n in own])
        return _all(spark, [_judged(measured, self.passing), *_scores(self.others, {self.name: written})], self.errors)


def score_suite(expectations: list[Expectation], datasets: Mapping[str, DataFrame],
                rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """``run_suite``, run now. If something fails while the data is read (a cast in a
    rule of your own, say), the expectations are run one by one, and those that fail
    are failed rows with the message."""
    spark = next(iter(datasets.values())).sparkSession
    try:
        rows = [tuple(r) for r in run_suite(expectations, datasets, rules).collect()]
    except PySparkException:
        rows = []
        for i, use in enumerate(expectations):
            try:
                rows.append((i, *tuple(run_suite([use], datasets, rules).first())[1:]))
            except PySparkException as e:
                message = str(e).strip().splitlines()[0]
                rows.append((i, use.rule_id, None, float(use.tolerance), False, None, None, message))
    return spark.createDataFrame(rows, RESULT)


def summarize(results: DataFrame, details: bool = False) -> DataFrame:
    """Suite totals: score is passed / total, success means all passed. With
    ``details`` also the single results as JSON text (one entry per rule)."""
    passed = F.count_if("success")
    total = F.count(F.lit(1))
    entries = F.sort_array(F.collect_list(
        F.struct("position", "rule_id", "success", "score", "error")))
    return results.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        F.round(passed / total, 4).alias("score"), (passed == total).alias("success"),
        *([F.to_json(entries).alias("details")] if details else []))


def failing_rows(expectations: list[Expectation], datasets: Mapping[str, DataFrame],
                 rules: Mapping[str, Rule] | None = None, order_by: str | list[str] | None = None) -> DataFrame:
    """The rows of a dataset that fail any of its expectations, with ``failed``: the
    positions of these in the suite, ascending. All expectations must be on one
    dataset, which is read once. Of rows with one key of a uniqueness rule all but
    the first in ``order_by`` fail; aggregate rules have no rows."""
    bound = [_bind(i, use, datasets, {**RULES, **(rules or {})}) for i, use in enumerate(expectations)]
    names = {b.dataset for b in bound}
    if len(names) != 1:
        raise ValueError(f"the suite must be on one dataset, not {sorted(names)}")
    df = datasets[names.pop()]
    found, bad = df, {}
    for b in bound:
        flag = f"__bad{b.position}"
        if b.rule.kind == "unique":
            found = flag_duplicates(found, list(b.columns.values()), order_by, flag)
        elif b.rule.kind == "in_other":
            found = with_membership(found, b.columns["x"], datasets[b.other], b.columns["y"], flag)
            found = found.withColumn(flag, ~F.col(flag))
        elif b.rule.kind == "row":
            found = found.withColumn(flag, ~truth(predicate(b.rule, df, b.columns, b.use.params)))
        else:
            continue
        bad[b.position] = F.when(F.col(flag), F.lit(b.position))
    failed = F.array_compact(F.array(*bad.values())) if bad else F.array().cast("array<int>")
    return found.withColumn("failed", failed).where(F.size("failed") > 0).select(
        *[F.col(f"`{c}`") for c in df.columns if c != "failed"], "failed")


def failed_rows(use: Expectation, datasets: Mapping[str, DataFrame],
                rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """The rows that fail one expectation, with the rule's name. For uniqueness
    these are all rows but the first of each key; aggregate rules have none."""
    b = _bind(0, use, datasets, {**RULES, **(rules or {})})
    df = datasets[b.dataset]
    if b.rule.kind == "aggregate":
        bad = df.where(F.lit(False))
    elif b.rule.kind == "unique":
        bad = flag_duplicates(df, list(b.columns.values()), flag="__dup") \
            .where("__dup").drop("__dup")
    elif b.rule.kind == "in_other":
        x = b.columns["x"]
        bad = anti_join(df, datasets[b.other].select(F.col(b.columns["y"]).alias(x)), x)
    else:
        bad = df.where(~truth(predicate(b.rule, df, b.columns, b.use.params)))
    return bad.withColumn("rule_id", F.lit(use.rule_id))
