"""Helpers of this package: columns computed over Arrow batches, tables written
to the shared folder, stable samples for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import remove, scratch

Batch = pa.RecordBatch
#: Makes, once per task, the function that computes the new columns of a batch.
Maker = Callable[[], Callable[[Batch], list]]


#: Rows whose texts are Python objects at a time.
SLICE = 1000


def with_arrow(df: DataFrame, added: str | T.StructType, maker: Maker) -> DataFrame:
    """``df`` with the columns of ``added``, computed per Arrow batch. A column
    of the same name is replaced; all others pass unchanged."""
    new = T.StructType.fromDDL(added) if isinstance(added, str) else added
    kept = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType([*kept, *new.fields])
    names = [f.name for f in kept]
    types = [_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        compute = maker()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                arrays = [column(batch, n) for n in names]
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=t)
                        for v, t in zip(compute(batch), types)]
                yield pa.RecordBatch.from_arrays([*arrays, *made],
                                                 names=[*names, *new.fieldNames()])

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def column(batch: Batch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks_of(batches: Iterator[Batch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each block, from batches in which a block's rows stand together.
    Keys are whole numbers."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.array([column(batch, c).to_numpy() for c in keys]).T
        starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
        for x, y in zip(starts, starts[1:]):
            key = tuple(int(k) for k in at[x])
            if key != last:
                if held:
                    yield last, pa.Table.from_batches(held)
                last, held = key, []
            held.append(batch.slice(x, y - x))
    if held:
        yield last, pa.Table.from_batches(held)


class Workspace:
    """A folder on the file system all executors share. Tables written there cut
    the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self._n = spark, scratch(spark), 0

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        """Write ``df`` and read it back."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}"
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table of this workspace that nothing reads any more."""
        if df is not None and getattr(df, "_workspace_path", None):
            remove(self.spark, df._workspace_path)


#: Tasks that write a small table at least, and narrow rows that one of them holds at most.
GATHERED_TASKS, GATHERED_ROWS = 32, 50_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most about ``rows`` narrow rows, in no more parts than these
    need: a small table is not written as one tiny file per shuffle partition."""
    return df.coalesce(max(GATHERED_TASKS, -(-rows // GATHERED_ROWS)))


def fold(key: str | Column, parts: int) -> Column:
    """The fold of a row: CRC-32 of the key's text, modulo ``parts``; a missing
    key is in fold 0."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


def sampled(key: str | Column, fraction: Column | float) -> Column:
    """A stable sample of rows for fitting a model, by a hash of their key."""
    c = F.col(key) if isinstance(key, str) else key
    share = F.lit(fraction) if isinstance(fraction, (int, float)) else fraction
    return F.pmod(F.xxhash64(c), F.lit(1 << 30)) < share * float(1 << 30)


#: Bits that tell which keys another table may have: 4 MB, whatever the table's size.
KEY_BITS = 1 << 25


def likely(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``others``: all whose key is, and some
    more where hashes meet. A join that follows shuffles fewer rows; its result stays.
    Keys of different types, which need not hash alike, leave ``df`` as it is."""
    if df.schema[key].dataType != others.schema[key].dataType:
        return df
    spot = F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1
    maps = others.select(spot.alias("__spot")).groupBy(F.bitmap_bucket_number("__spot").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__spot")).alias("__map"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return df.withColumn("__bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(maps), "__bucket").where(
        F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)
