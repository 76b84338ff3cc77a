"""Shaping landed raw data: JSON response bodies and spreadsheet tabs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import require
from ..operators.sets import stack

# Names under which a response body may hold its records, in order.
RECORD_KEYS = ("data", "results", "items", "records", "content", "entries", "rows")

_LIST = "array<variant>"


def _list_at(doc: str, key: str | None = None) -> Column:
    """The list in a variant column, or under one of its keys; null when there
    is none."""
    return F.try_variant_get(doc, F.lit(_path(key)), _LIST)


def _path(key: str | None) -> str:
    if key is None:
        return "$"
    if '"' in key and "'" in key:
        raise ValueError(f"key cannot be quoted in a path: {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def record_list(df: DataFrame, body: str, name: str, data_key: str | None = None) -> DataFrame:
    """Add the records of a JSON body as an array of variants: the body itself
    when it is a list; else the value of ``data_key`` if that key is present;
    else the first well-known key holding a list; else the only list among the
    values; else null. The body is parsed once, and only bodies without a named
    list are taken apart for the last step."""
    doc = "__doc"
    parsed = df.withColumn(doc, F.try_parse_json(F.col(body)))
    fields = F.try_variant_get(doc, F.lit("$"), "map<string,variant>")
    lists = F.filter(
        F.transform(F.map_values(fields), lambda v: F.try_variant_get(v, F.lit("$"), _LIST)),
        lambda v: v.isNotNull())
    only = F.when(F.size(lists) == 1, F.get(lists, F.lit(0)))
    found = F.coalesce(*[_list_at(doc, k) for k in RECORD_KEYS], only)
    if data_key:
        present = F.try_variant_get(doc, F.lit(_path(data_key)), "variant").isNotNull()
        found = F.when(present, _list_at(doc, data_key)).otherwise(found)
    return parsed.withColumn(name, F.coalesce(_list_at(doc), found)).drop(doc)


def pages_to_rows(df: DataFrame, body: str, data_key: str | None = None,
                  schema: str | T.DataType | None = None, name: str = "record") -> DataFrame:
    """One row per record of each body; other columns are repeated. Records are
    JSON text, or structs when a ``schema`` is given."""
    require(df, [body])
    rest = [c for c in df.columns if c != body]
    listed = record_list(df, body, "__records", data_key)
    items = listed.select(*rest, F.explode("__records").alias(name))
    if schema is None:
        return items.withColumn(name, F.to_json(name))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    if not kind.lower().startswith("struct<"):
        kind = T.StructType.fromDDL(kind).simpleString()
    return items.withColumn(name, F.try_variant_get(name, F.lit("$"), kind))


def infer_json_schema(df: DataFrame, column: str) -> str:
    """The merged schema of a JSON text column as a DDL string, from one
    aggregate over the column."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column)))).first()[0]
    return (found or "STRUCT<>").replace("OBJECT<", "STRUCT<")


def _element_text(e: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.when(e, "True").when(~e, "False")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.to_json(e)
    return e.cast("string")


def flatten_json(df: DataFrame, column: str | None = None, schema: str | T.DataType | None = None,
                 sep: str = "_", list_sep: str = ", ") -> DataFrame:
    """Nested fields to top-level columns named ``parent_child``. Lists of plain
    values become one joined text, lists of records JSON text. ``column`` (JSON
    text, with ``schema``) is parsed and flattened in place of itself."""
    if column:
        require(df, [column])
        if schema is not None:
            df = df.withColumn(column, F.from_json(F.col(column), schema))
    out: list[Column] = []
    names: list[str] = []

    def add(c: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                add(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}" if name else f.name)
            return
        if isinstance(kind, T.ArrayType):
            element = kind.elementType
            if isinstance(element, (T.StructType, T.MapType)):
                c = F.when(F.size(c) == 0, "").otherwise(F.to_json(c))
            else:
                c = F.array_join(F.transform(c, lambda e: _element_text(e, element)),
                                 list_sep, "None")
        elif isinstance(kind, T.MapType):
            c = F.to_json(c)
        out.append(c.alias(name))
        names.append(name)

    for f in df.schema:
        if column and f.name != column:
            out.append(F.col(f.name))
            names.append(f.name)
        else:
            add(F.col(f.name), f.dataType, "" if f.name == column else f.name)
    if len(set(names)) < len(names):
        raise ValueError(f"flattened names collide: {sorted(names)}")
    return df.select(*out)


def _number(c: str) -> Column:
    """Text as a number, null when it is none (the text NaN included)."""
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def numeric_text_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Text columns with at least one value that reads as a number: one
    aggregate over all of them."""
    text = [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not text:
        return []
    seen = df.agg(*[F.count(_number(c)).alias(c) for c in text]).first()
    return [c for c in text if seen[c] > 0]


def clean_sheet(sheets: Mapping[str, DataFrame], key_column: str | int | None = None,
                add_sheet_column: bool | None = None, numeric_coerce: bool = True,
                coerce_exclude: list[str] = ()) -> DataFrame:
    """Union the tabs of a workbook: rows without a key are dropped, a ``sheet``
    column is added when there are several tabs, and text columns in which any
    value reads as a number become numbers (others null). ``key_column`` may be
    a position; a tab without that column keeps all rows."""
    if not sheets:
        raise ValueError("no sheets given")
    named = len(sheets) > 1 if add_sheet_column is None else add_sheet_column
    frames = []
    for name, df in sheets.items():
        key = df.columns[key_column] if isinstance(key_column, int) else key_column
        if key in df.columns:
            df = df.where(F.col(key).isNotNull())
        frames.append(df.select(F.lit(name).alias("sheet"), "*") if named else df)
    merged = stack(frames)
    if not numeric_coerce:
        return merged
    skip = [*coerce_exclude, *(["sheet"] if named else [])]
    numbers = set(numeric_text_columns(merged, skip))
    return merged.select(*[_number(c).alias(c) if c in numbers else F.col(c)
                           for c in merged.columns])
