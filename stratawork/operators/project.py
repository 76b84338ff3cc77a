"""Row filters and projections. All are narrow: no shuffle, and Catalyst
pushes filters and the column list into the scan."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordering import as_list, require


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which ``condition`` holds. A string is Spark SQL with SQL's
    null rules; build the condition from ``functions.nulls`` for comparisons
    in which a missing value counts as "not equal"."""
    return df.where(condition)


def select(df: DataFrame, columns: str | list[str]) -> DataFrame:
    names = as_list(columns)
    require(df, names)
    return df.select(*names)


def derive(df: DataFrame, columns: list[Mapping[str, Any]]) -> DataFrame:
    """Add or replace columns one after another; a later one may use an
    earlier one. Entries: ``{name, expr}`` (Spark SQL text or Column) or
    ``{name, source, mapping}``."""
    for spec in columns:
        name, expr, mapping = spec["name"], spec.get("expr"), spec.get("mapping")
        if (expr is None) == (mapping is None):
            raise ValueError(f"column '{name}': give either expr or mapping")
        if mapping is not None:
            if not spec.get("source"):
                raise ValueError(f"column '{name}': mapping needs source")
            df = derive_mapping(df, name, spec["source"], mapping)
        else:
            df = df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
    return df


def derive_mapping(df: DataFrame, name: str, source: str, mapping: Mapping[Any, Any]) -> DataFrame:
    """Static value to label, null when unmatched. The mapping becomes a table of
    keys, cast to the type of ``source``, and labels of their own type, whatever its
    length; a replaced column keeps its place. Keys that fit no value of ``source``
    never match, a missing key neither; keys that are the same value there are an
    error. The table is a local relation, so Catalyst knows its size and broadcasts it
    up to the threshold of the session."""
    require(df, [source])
    if not mapping:
        label = F.lit(None).cast("string")
    else:
        table = _mapping_table(df.sparkSession, df.schema[source].dataType, mapping)
        # Local rows: neither collecting them nor their size needs a job.
        seen: set[str] = set()
        for r in table.select("__key").collect():
            known = repr(r[0] + 0.0 if isinstance(r[0], float) else r[0])  # 0.0 is -0.0
            if known in seen:
                raise ValueError(f"column '{name}': several keys are the same value {r[0]!r} of '{source}'")
            seen.add(known)
        df, label = df.join(table, F.col(source) == F.col("__key"), "left"), F.col("__label")
    names = [c for c in df.columns if c not in ("__key", "__label")]
    out = [label.alias(c) if c == name else F.col(c) for c in names]
    return df.select(*out, *([] if name in names else [label.alias(name)]))


def _mapping_table(spark: SparkSession, kind: T.DataType, mapping: Mapping[Any, Any]) -> DataFrame:
    """Keys of the type ``kind`` and labels, as a local relation."""
    labels = spark.createDataFrame([(v,) for v in mapping.values()], ["v"]).schema["v"].dataType
    pairs = [(str(k), v) for k, v in mapping.items() if k is not None]
    if isinstance(labels, T.StringType):  # of labels of several types, all become text
        pairs = [(k, v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v))
                 for k, v in pairs]
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField("__label", labels)])
    held = pa.Table.from_pydict({"__key": [k for k, _ in pairs], "__label": [v for _, v in pairs]}, to_arrow_schema(schema))
    key = F.col("__key").try_cast(kind)
    if isinstance(kind, T.IntegralType):  # 1.0 is 1
        real = F.col("__key").try_cast("double")
        key = F.coalesce(key, F.when(real == F.floor(real), real.try_cast(kind)))
    return spark.createDataFrame(held).select(key.alias("__key"), "__label").dropna(subset=["__key"])


def add_constant(df: DataFrame, name: str, value: Any, replace: bool = False) -> DataFrame:
    """A constant column; an existing one is kept unless ``replace``."""
    return df if name in df.columns and not replace else df.withColumn(name, F.lit(value))


def drop_nulls(df: DataFrame, subset: str | list[str] | None = None) -> DataFrame:
    names = as_list(subset)
    require(df, names)
    return df.dropna(how="any", subset=names or None)


def rename_safe(df: DataFrame) -> DataFrame:
    """Column names that every file format accepts (pivoted values become
    names as they are, with spaces, commas or dots)."""
    bad = str.maketrans({c: "_" for c in " ,;{}()\n\t=.`"})
    names = [c.translate(bad) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after clean-up: {names}")
    return df.toDF(*names)
