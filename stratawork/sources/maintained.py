"""Tables kept up to date by deliveries, of which a delivery writes only what it
touches: a version names the folders of its parts, and shares the others with the
version before."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import as_list, require
from ..operators import incremental
from . import files
from .versions import SYSTEM, Commit, Store

BUCKET = "__bucket"
#: Buckets of a new table, unless given: a bucket is the least that is written anew.
BUCKETS = 64
#: Parts of an accumulated table before it is written anew as one.
MAX_PARTS = 200


def _schema(row: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(row["schema"]))


def _cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a delivery in the types the table has them in."""
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, df.schema[c].dataType)).alias(c) for c in df.columns])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def upsert(store: Store, dataset: str, today: DataFrame, key: str | list[str],
           order_by: str | list[str] | None = None, metadata: Mapping[str, Any] | None = None,
           inputs: list[tuple[str, str]] = (), buckets: int = BUCKETS) -> Commit:
    """``incremental.upsert`` into the latest version, which lies in buckets by a hash
    of the key. Only buckets that ``today`` has keys of are read and written; the files
    of the others become part of the new version as they are.

    The first delivery, and one that changes the key or the type of a column, writes
    all buckets. A column that is new today is null in the others. An empty delivery
    writes nothing. ``today`` is read twice: give one that is written down."""
    keys = as_list(key)
    require(today, keys)

    def produce(last: Row | None, location: str) -> tuple[T.StructType, dict[str, str], dict[str, Any]]:
        before = _schema(last) if last is not None and last["schema"] else None
        held = last["metadata"] if last is not None else {}
        n = int(held.get(f"{SYSTEM}buckets", buckets))
        delivery = today if before is None else _cast(today, T.StructType([f for f in before if f.name in keys]))
        kept: dict[str, str] = {}
        previous = None
        if last is not None:
            types = {f.name: f.dataType for f in before or ()}
            same = all(types.get(f.name, f.dataType) == f.dataType for f in delivery.schema)
            if last["parts"] is not None and same and held.get(f"{SYSTEM}bucket_key") == ",".join(keys):
                found = delivery.select(bucket_of(keys, n).alias("b")).distinct().collect()  # at most n
                touched = {str(r["b"]) for r in found}
                kept = {b: p for b, p in last["parts"].items() if b not in touched}
                previous = store.open_parts({b: p for b, p in last["parts"].items() if b in touched}, before)
            else:
                previous = store.read(dataset, last["version"])
        table = incremental.upsert(previous, delivery, keys, order_by)
        files.sink(table.withColumn(BUCKET, bucket_of(keys, n)), location, partition_by=[BUCKET])
        written = [f for f in files.names(store.spark, location) if f.startswith(f"{BUCKET}=")]
        parts = kept | {f.split("=")[1]: f"{location}/{f}" for f in written}
        return table.schema, parts, {"buckets": n, "bucket_key": ",".join(keys)}

    return store.commit_parts(dataset, produce, metadata, inputs)


def digest(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of the cells of a row, as two numbers; missing cells equal each other."""
    cells = [F.struct(F.lit(c), F.col(f"`{c}`").isNull(), F.to_json(F.col(f"`{c}`"))
                      if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(f"`{c}`"))
             for c in sorted(columns)]
    return [F.xxhash64(F.lit(i), *cells).alias(f"__d{i}") for i in (1, 2)]


def accumulate_dedup(store: Store, dataset: str, today: DataFrame, date_column: str, date_value: object,
                     metadata: Mapping[str, Any] | None = None, inputs: list[tuple[str, str]] = ()) -> Commit:
    """``incremental.accumulate_dedup`` into the latest version: one row per distinct
    state (all columns but the date) with the earliest date it was seen on.

    A narrow index holds the digest of every state. A delivery meets the digests only,
    and appends the states that are new: the cells of the history are neither read nor
    shuffled. A delivery of an earlier date than the last, other columns or types, and
    every ``MAX_PARTS``-th delivery write the table and its index anew. ``today`` is read
    twice: give one that is written down."""
    if date_value is None:
        raise ValueError("the date of the delivery is required")
    value = str(date_value)
    keys = ["__d1", "__d2"]

    def produce(last: Row | None, location: str) -> tuple[T.StructType, dict[str, str], dict[str, Any]]:
        before = _schema(last) if last is not None else None
        rows = incremental.accumulate_dedup(None, today, date_column, value) if before is None \
            else _cast(incremental.accumulate_dedup(None, today, date_column, value), before)
        state = [c for c in rows.columns if c != date_column]
        parts = dict(last["parts"] or {}) if last is not None else {}
        grows = bool(parts) and len(parts) < 2 * MAX_PARTS and set(before.names) == set(rows.columns) \
            and value >= last["metadata"][f"{SYSTEM}last_date"]
        if grows:
            known = store.open_parts({n[1:]: p for n, p in parts.items() if n.startswith(".")}, INDEX)
            fresh = rows.select("*", *digest(rows, state)).join(known, keys, "left_anti")
            rows = rows.select(*before.names)
        else:
            parts = {}
            if last is not None:
                rows = incremental.accumulate_dedup(store.read(dataset, last["version"]), today, date_column, value)
            fresh = rows.select("*", *digest(rows, state))
        # Rows and digests lie side by side; each reader takes its columns.
        files.sink(fresh, f"{location}/rows")
        files.sink(files.scan(store.spark, f"{location}/rows", schema=INDEX), f"{location}/index")
        number = f"{len(parts) // 2:06d}"
        newest = max(value, last["metadata"].get(f"{SYSTEM}last_date", value)) if last is not None else value
        return (rows.schema, parts | {number: f"{location}/rows", f".{number}": f"{location}/index"},
                {"last_date": newest})

    return store.commit_parts(dataset, produce, metadata, inputs)


INDEX = T.StructType([T.StructField(c, T.LongType()) for c in ("__d1", "__d2")])
