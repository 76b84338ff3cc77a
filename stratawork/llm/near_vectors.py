"""Near-duplicate vectors: signs against random hyperplanes in several tables, exact
cosine in double precision, connected components.

Equal vectors become one class with a count. A class falls into one bucket per
table; the bits per table grow with the number of classes, so that a bucket keeps
its size, and the tables with the bits, so that a pair at the threshold meets in
one of them with probability 1 - ``miss``.

A bucket is compared in blocks. A large one is dealt out by a hash into parts of
bounded size, and each pair of parts is a block, so no task or group holds a whole
bucket. A block counts the links of each member and gives one row per linked member
with the smallest it reaches there: links are never listed as pairs. A pair that
meets in several tables counts in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, blocks_of, column
from .components import components

#: Classes per bucket to aim at, and members of a part.
BUCKET, PART = 64, 1024


def tables_for(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per table and number of tables."""
    bits = min(30, max(4, round(math.log2(max(2, classes) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def planes(size: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, tables * bits))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables)) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors of equal length."""
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of huge and tiny values
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _comparable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Key, digest and doubles of each vector; the last two null where it is null,
    empty, zero, or holds a null or a value that is not finite."""
    schema = T.StructType.fromDDL("id bigint, digest binary, v binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x in column(batch, vector):
                values = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    values = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if not np.isfinite(values).all() or not values.any():
                        values = None
                held.append(None if values is None else values.tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, key), pa.array([h and xxhash.xxh3_128_digest(h) for h in held], pa.binary()),
                 pa.array(held, pa.binary())], names=schema.fieldNames())

    return vectors.select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, schema)


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = column(batch, "v").to_pylist()
            ids = column(batch, "id").to_numpy()
            for size in sorted({len(r) for r in raw}):
                at = np.array([i for i, r in enumerate(raw) if len(r) == size])
                found = codes(unit([raw[i] for i in at]), bits, tables)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[at], tables)), pa.array(np.full(found.size, size // 8)),
                    pa.array(np.tile(np.arange(tables), len(at))), pa.array(found.reshape(-1))],
                    names=["id", "size", "t", "bucket"])

    return classes.select("id", "v").mapInArrow(run, "id bigint, size bigint, t bigint, bucket bigint")


def links_in_block(v: np.ndarray, part: np.ndarray, ids: np.ndarray, n: np.ndarray, one_part: bool,
                   t: int, bits: int, tables: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Of a block's members: which have links, how many, the smallest reached."""
    if one_part:
        left = right = np.arange(len(v))
    else:
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    close = v[left] @ v[right].T >= threshold
    a, b = np.nonzero(close)
    a, b = left[a], right[b]
    keep = (a < b if one_part else np.ones(len(a), bool)) & (ids[a] != ids[b])
    a, b = a[keep], b[keep]
    if t and len(a):
        who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        before = codes(v[who], bits, tables)[:, :t].astype(np.int32)
        x, y = at[:len(a)], at[len(a):]
        new = np.concatenate([~(before[x[i:i + 50_000]] == before[y[i:i + 50_000]]).any(axis=1)
                              for i in range(0, len(x), 50_000)])
        a, b = a[new], b[new]
    count = np.zeros(len(v), np.int64)
    np.add.at(count, a, n[b])
    np.add.at(count, b, n[a])
    low = ids.copy()
    while len(a):  # the smallest id spreads along the links
        least = low.copy()
        np.minimum.at(least, a, low[b])
        np.minimum.at(least, b, low[a])
        if (least == low).all():
            break
        low = least
    has = np.flatnonzero(count)
    return ids[has], count[has], low[has]


def _compared(blocks: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Rows (id, links, low) of all blocks; rows of a block stand together."""
    names = ("t", "bucket", "size", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in blocks_of(batches, names):
            if rows.num_rows < 2:
                continue
            ids, count, low = links_in_block(
                unit(rows["v"].to_pylist()), rows["part"].to_numpy(), rows["id"].to_numpy(),
                rows["n"].to_numpy(), key[3] == key[4], key[0], bits, tables, threshold)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(low)],
                                                 names=["id", "links", "low"])

    return blocks.mapInArrow(run, "id bigint, links bigint, low bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = 0.9, miss: float = 1e-3) -> DataFrame:
    """Per row: the key, ``n_links`` (other vectors linked to it), ``component_id``
    (the smallest key reachable, its own included), ``kept`` (it is its
    component's smallest).

    Vectors are linked if they have the same length, meet in a bucket, and their
    cosine is at least ``threshold``. Null, empty and zero vectors and those with a
    null or a value that is not finite have no links. Keys are whole numbers. Rows
    that repeat a key are each judged by their own vector, and are not linked with
    each other unless equal. A row without key has no links, a null component, and
    is kept. An empty table gives no rows; other columns are not kept."""
    work = Workspace(vectors.sparkSession)
    rows = work.table(_comparable(vectors, key, vector))
    usable = rows.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    counted = usable.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = work.table(usable.join(counted, ["digest", "id"]).dropDuplicates(["digest", "id"])
                         .select("id", "digest", "n", "v"))
    bits, tables = tables_for(classes.count(), threshold, miss)

    placed = work.table(_buckets(classes, bits, tables))
    keys = ["t", "bucket", "size"]
    parts = placed.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(
        *keys, F.ceil(F.col("c") / PART).alias("parts"))
    # Each member goes to the blocks of its part with every part, its own included.
    member = placed.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    member = member.select(*keys, "id", "part", F.least("part", "with").alias("i"),
                           F.greatest("part", "with").alias("j"))
    blocks = member.join(classes.select("id", "n", "v"), "id").repartition(*keys, "i", "j").sortWithinPartitions(
        *keys, "i", "j")
    found = work.table(_compared(blocks, bits, tables, threshold))

    groups = components(work, found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.select("digest", "id", "n").join(links, "id", "left").join(
        groups.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    named = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    return named.join(of, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))
