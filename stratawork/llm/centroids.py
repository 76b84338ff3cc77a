"""Clustering round centroids, with zone maps along a Hilbert curve.

Vectors become whole numbers, so that every distance, sum and mean is exact and no
result depends on the order of work. They are ordered along a Hilbert curve through
the directions in which the first centroids differ most, dealt out by ranges of it and
cut into blocks, each with the box of its smallest and largest components. The blocks
are written once; each round reads them.

For a block, the centroid nearest to the middle of its box leads. Over the box, the
difference of the distances to the leader and to another centroid is linear, so its
greatest value stands at a corner: a centroid that is farther than the leader at every
point is out. What is left are the block's candidates, compared with its vectors
exactly in whole arrays; where only the leader is left, nothing is compared. A task
gives one sum per centroid and component, whatever its number of vectors.

Equal vectors have the same place on the curve and are dealt on by a hash of their
keys. The driver holds the centroids and their sums only: ``k`` times ``size`` numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, column

#: Vectors of a block.
BLOCK = 256
#: Whole components lie within this, so that squared distances fit 64 bits.
LIMIT = 1 << 26
#: Directions of the curve, and bits of its places in all.
AXES, PLACE_BITS = 9, 63
#: Directions are whole numbers of this unit: places are the same on all machines.
UNIT = 1 << 15


def whole(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """Rows (key, point) of the vectors that have exactly ``size`` components, all
    finite; a component x is floor(scale * x) in double precision, within ±2^26."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    bound = F.lit(LIMIT).cast("bigint")
    point = F.transform(vector, lambda x: F.greatest(-bound, F.least(bound, F.floor(x.cast("double") * scale))).cast("int"))
    return vectors.where((F.size(vector) == size) & finite).select(F.col(key).alias("key"), point.alias("point"))


def starts(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The points of the ``k`` rows whose keys, behind ``seed`` and a colon, have the
    smallest SHA-256; a missing key is the empty text, rows of one key stand in the
    order of their points."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = points.select(F.sha2(name, 256).alias("h"), "point").orderBy("h", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64)


class Curve:
    """Places along a Hilbert curve through the box round the first centroids, in
    the leading directions of their differences."""

    def __init__(self, centres: np.ndarray):
        off = centres - centres.mean(axis=0)
        _, _, turned = np.linalg.svd(off, full_matrices=False)
        self.axes = np.rint(turned[:AXES].T * UNIT).astype(np.int64)
        self.bits = min(16, PLACE_BITS // self.axes.shape[1])
        seen = centres @ self.axes
        span = np.maximum(seen.max(axis=0) - seen.min(axis=0), UNIT)
        self.low, self.width = seen.min(axis=0) - span // 2, 2 * span

    def places(self, points: np.ndarray) -> np.ndarray:
        """Outside the box, the nearest cell of it counts."""
        at = np.clip(points @ self.axes - self.low, 0, self.width - 1)
        return hilbert(at * (1 << self.bits) // self.width, self.bits)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of whole numbers below 2**bits) on the Hilbert curve,
    by Skilling's transposition (2004), all rows at once."""
    x, axes = cells.astype(np.int64), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(axes):
            high = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | x[:, i] >> b & 1
    return place


def _points(arrays: pa.Array, size: int) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def blocks(work: Workspace, points: DataFrame, curve: Curve, size: int) -> DataFrame:
    """The table of blocks: keys, points (32-bit numbers in a row) and the box."""
    key = points.schema["key"].dataType

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = curve.places(_points(column(b, "point"), size))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "place"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                p = _points(column(part, "point"), size)
                yield pa.RecordBatch.from_pydict({
                    "keys": pa.array([column(part, "key").to_pylist()], pa.list_(column(part, "key").type)),
                    "points": [p.astype("<i4").tobytes()],
                    "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()]})

    placed = points.mapInArrow(place, T.StructType([*points.schema.fields, T.StructField("place", T.LongType())]))
    order = ["place", F.xxhash64("key"), "key"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    longs = T.ArrayType(T.LongType())
    return work.table(dealt.mapInArrow(cut, T.StructType([
        T.StructField("keys", T.ArrayType(key)), T.StructField("points", T.BinaryType()),
        T.StructField("low", longs), T.StructField("high", longs)])))


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box, ascending."""
    lead = ((2 * centres - low - high).astype(np.float64) ** 2).sum(axis=1).argmin()
    to = centres - centres[lead]
    squares = (centres * centres).sum(axis=1)
    # Greatest value over the box of the leader's distance less the other's.
    most = 2 * np.maximum(low * to, high * to).sum(axis=1) + squares[lead] - squares
    return np.flatnonzero(most >= 0)  # at 0 both may be equally near


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray,
            centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point of a block (the smaller number if equally near)
    and the squared distance."""
    left = candidates(low, high, centres)
    if len(left) == 1:
        off = points - centres[left[0]]
        return np.full(len(points), left[0]), (off * off).sum(axis=1)
    near = centres[left]
    far = (points * points).sum(axis=1)[:, None] - 2 * points @ near.T + (near * near).sum(axis=1)
    at = far.argmin(axis=1)
    return left[at], far[np.arange(len(points)), at]


def _each(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        keys, low, high = (column(b, n) for n in ("keys", "low", "high"))
        for i, raw in enumerate(column(b, "points")):
            yield (keys[i].values, np.frombuffer(raw.as_buffer(), "<i4").reshape(-1, size).astype(np.int64),
                   low[i].values.to_numpy(), high[i].values.to_numpy())


def moved(zones: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors, those
    without vectors as they were."""
    k, size = centres.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, points, low, high in _each(batches, size):
            at, _ = nearest(points, low, high, centres)
            for c in np.unique(at):
                total[c] += points[at == c].sum(axis=0)
            n += np.bincount(at, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(np.repeat(has, size)), "i": pa.array(np.tile(np.arange(size), len(has))),
            "total": pa.array(total[has].ravel()), "n": pa.array(np.repeat(n[has], size))})

    parts = zones.mapInArrow(run, "c long, i long, total long, n long").groupBy("c", "i").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in parts.collect():  # k * size rows
        out[r["c"], r["i"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16,
            rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per vector of ``size`` finite components: key, ``cluster`` (the number of
    its nearest centroid), ``distance`` (squared), ``cluster_inertia`` and ``inertia``
    (its sum over the cluster and over all; beyond 64 bits the largest number) and
    ``centroid_sha256`` (of the components in decimal, joined by commas).

    Null vectors, other sizes and null or non-finite components give no row; null and
    repeated keys are rows like others. With fewer than ``k`` such vectors there are as
    many centroids; none give an empty table. Equal vectors may give equal centroids:
    the smaller number takes all, the other stays. Other columns are left out."""
    spark = vectors.sparkSession
    work = Workspace(spark)
    points = whole(vectors, key, vector, size, scale)
    centres = starts(points, k, seed)
    kind = vectors.schema[key]
    if not len(centres):
        return spark.createDataFrame([], T.StructType([
            T.StructField(key, kind.dataType), T.StructField("cluster", T.IntegerType()),
            *(T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")),
            T.StructField("centroid_sha256", T.StringType())]))
    zones = blocks(work, points, Curve(centres), size)
    for _ in range(rounds):
        centres = moved(zones, centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, p, low, high in _each(batches, size):
            at, far = nearest(p, low, high, centres)
            yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int32()), pa.array(far)],
                                             names=[key, "cluster", "distance"])

    near = work.table(zones.mapInArrow(run, T.StructType([
        T.StructField(key, kind.dataType), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType())])))
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    held = {r["cluster"]: int(r["s"]) for r in sums}  # at most k rows
    most = (1 << 63) - 1

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    inertia = [min(most, held.get(c, 0)) for c in range(len(centres))]
    return near.select(key, "cluster", "distance", of_cluster(inertia).cast("bigint").alias("cluster_inertia"),
                       F.lit(min(most, sum(held.values()))).cast("bigint").alias("inertia"),
                       of_cluster(digests).alias("centroid_sha256"))


def oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> str:
    """The same in DuckDB's SQL, over the table ``embeddings``."""
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {size}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v
        FROM kept QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v),
            lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k, c{r} c
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c.c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)""")
            parts.append(f"""c{r + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN
        (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
    CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} o ON a.c = o.c"""
