"""Column records: inference, drift and annotations."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_RECORD = "name string, physical_type string, logical_type string"
NOTES = ("logical_type", "description", "nullable", "pii", "pii_type", "pii_notes")


def logical_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return "integer"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "decimal"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def column_records(df: DataFrame) -> list[tuple[str, str, str]]:
    return [(f.name, f.dataType.simpleString(), logical_type(f.dataType)) for f in df.schema]


def infer_schema(df: DataFrame) -> DataFrame:
    """Name, physical and logical type per column. No data is read."""
    return records_frame(df.sparkSession, column_records(df), COLUMN_RECORD)


#: What a text can be read as, one bit each. The type of a column is the least that
#: holds all its values: 0 bits say nothing, bits that no type holds make it text.
KINDS = {"boolean": 1, "integer": 2, "decimal": 4, "datetime": 8, "string": 16}
JOINS = {0: "string", 1: "boolean", 2: "integer", 4: "decimal", 6: "decimal", 8: "datetime"}


def _kind_of(text: Column) -> Column:
    """The bit of a text, null for a missing or blank one. Numbers that begin with a
    zero are codes, not numbers."""
    t = F.trim(text)
    known = {
        "boolean": F.lower(t).isin("true", "false"),
        "integer": t.rlike("^[+-]?(0|[1-9][0-9]*)$") & t.try_cast("bigint").isNotNull(),
        "decimal": t.rlike(r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & t.try_cast("double").isNotNull(),
        "datetime": t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$")
        & t.try_cast("timestamp_ntz").isNotNull()}
    out = F.when(t.isNull() | (t == ""), F.lit(None))
    for kind, test in known.items():
        out = out.when(test, KINDS[kind])
    return out.otherwise(KINDS["string"])


def infer_types(df: DataFrame) -> DataFrame:
    """Column records whose logical types come from the values: a text column is what
    all its texts can be read as. Also ``nullable``, whether a value is missing (blank
    texts are), and ``n_missing``. One aggregate over the table, merged by bits and
    sums; one row per column, also for an empty table."""
    measures = []
    for i, f in enumerate(df.schema):
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            kind = _kind_of(cell)
            missing = kind.isNull()
            measures.append(F.coalesce(F.bit_or(kind), F.lit(0)).alias(f"k{i}"))
        else:
            missing = cell.isNull() | F.isnan(cell) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) \
                else cell.isNull()
        measures.append(F.count_if(missing).alias(f"m{i}"))
    join = F.create_map(*[F.lit(v) for pair in JOINS.items() for v in pair])

    def record(i: int, f: T.StructField) -> Column:
        kind = F.coalesce(join[F.col(f"k{i}")], F.lit("string")) if isinstance(f.dataType, T.StringType) \
            else F.lit(logical_type(f.dataType))
        return F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("physical_type"),
                        kind.alias("logical_type"), (F.col(f"m{i}") > 0).alias("nullable"),
                        F.col(f"m{i}").alias("n_missing"))
    return df.agg(*measures).select(F.inline(F.array(*[record(i, f) for i, f in enumerate(df.schema)])))


def drift(published: DataFrame, now: DataFrame, by: str = "physical_type") -> DataFrame:
    """Where column records depart from published ones: a column is gone (``missing``)
    or is of another type (``type_change``). New columns are no departure."""
    new = now.select("name", F.col(by).alias("new_type"))
    both = published.select("name", F.col(by).alias("old_type")).join(new, "name", "left")
    same = F.col("old_type").eqNullSafe(F.col("new_type"))
    return both.where(~same).withColumn(
        "change", F.when(F.col("new_type").isNull(), "missing").otherwise("type_change"))


def schema_diff(published: DataFrame, df: DataFrame) -> DataFrame:
    """``drift`` of the physical types of ``df``."""
    return drift(published, infer_schema(df))


def drift_messages(published: list[tuple[str, str]], df: DataFrame) -> list[str]:
    """``schema_diff`` from (name, type) pairs, in words, by name."""
    if not published:
        return []
    was = records_frame(df.sparkSession, published, "name string, physical_type string")
    return [f"{r['name']}: {r['old_type']} is " + ("gone" if r["change"] == "missing" else f"now {r['new_type']}")
            for r in schema_diff(was, df).orderBy("name").collect()]


def annotate_columns(df: DataFrame, notes: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Attach notes to columns as metadata, which Parquet keeps."""
    for name, entry in notes.items():
        unknown = set(entry) - set(NOTES)
        if unknown:
            raise ValueError(f"unknown notes for '{name}': {sorted(unknown)}")
        df = df.withMetadata(name, {**df.schema[name].metadata, **entry})
    return df


def column_notes(df: DataFrame) -> dict[str, dict]:
    return {f.name: dict(f.metadata) for f in df.schema if f.metadata}


def schema_summary(records: DataFrame) -> DataFrame:
    """Counts over column records with ``pii`` and ``status``."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pii")).alias("pii"),
        *[F.count_if(F.col("status") == s).alias(s)
          for s in ("inferred", "draft", "published")])


def records_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few bookkeeping rows as a one-partition DataFrame of literals: needs no
    Python worker."""
    kinds = T.StructType.fromDDL(schema)

    def literal(value: Any, kind: T.DataType) -> Column:
        if value is None:
            return F.lit(None).cast(kind)
        if isinstance(value, Mapping):
            keys, held = [F.lit(k) for k in value], [F.lit(v) for v in value.values()]
            value = F.map_from_arrays(F.array(*keys), F.array(*held)) if value else F.create_map()
        elif isinstance(kind, T.ArrayType):
            value = F.array(*[literal(v, kind.elementType) for v in value])
        elif isinstance(kind, T.StructType):
            value = F.struct(*[cell(v, f) for v, f in zip(value, kind)])
        return F.lit(value).cast(kind)

    def cell(value: Any, f: T.StructField) -> Column:
        return literal(value, f.dataType).alias(f.name)
    if not rows:
        return spark.range(0, 0, 1, 1).select(*[cell(None, f) for f in kinds])
    structs = [F.struct(*[cell(v, f) for v, f in zip(row, kinds)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
