"""Clustering round centroids."""

import hashlib
import math

import numpy as np
import pytest

from stratawork.llm import centroids
from stratawork.llm.queries import op12_clusters
from tests.conftest import DATA


def plain(rows, k=16, rounds=3, size=64, scale=64, seed="1"):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(scale * float(x)))) for x in v])
            for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]

    def name(i):
        return hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()

    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (_, n) in zip(kept, at) if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    each = [sum(d for d, n in at if n == c) for c in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, d, each[n], sum(each), digests[n]) for (i, _), (d, n) in zip(kept, at)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (5, 2), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        place = centroids.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_boxes_never_lose_the_nearest():
    rng = np.random.default_rng(3)
    pruned = 0
    for n in range(300):
        size, k = rng.integers(1, 6), rng.integers(1, 9)
        p = rng.integers(-4, 5, (rng.integers(1, 30), size)) + rng.integers(-9, 10, size)
        c = rng.integers(-12, 13, (k, size))
        at, far = centroids.nearest(p, p.min(axis=0), p.max(axis=0), c)
        every = ((p[:, None] - c[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        pruned += k - len(centroids.candidates(p.min(axis=0), p.max(axis=0), c))
    assert pruned > 100


def test_blocks_along_the_curve_have_few_candidates(spark):
    """On vectors in clusters, most centroids leave most blocks unseen."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(16, 64)) * 4
    rows = [(i, (middles[i % 16] + rng.normal(size=64) * 0.2).tolist()) for i in range(16384)]
    points = centroids.whole(frame(spark, rows), "vec_id", "embedding", 64, 64)
    centres = np.floor(middles * 64).astype(np.int64)
    zones = centroids.blocks(centroids.Workspace(spark), points, centroids.Curve(centres), 64).collect()
    assert sum(len(z["keys"]) for z in zones) == 16384
    left = [len(centroids.candidates(np.array(z["low"]), np.array(z["high"]), centres)) for z in zones]
    assert np.median(left) == 1 and np.mean(left) < 8


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range(60)]
    hot = rng.normal(size=64).tolist()
    rows += [(100 + i, hot) for i in range(40)] + [(7, hot), (7, hot), (None, hot)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63),
             (205, [math.nan] + [1.0] * 63), (206, [math.inf] + [1.0] * 63), (207, [1e300] * 64), (208, [-1e300] * 64)]
    df = frame(spark, rows).selectExpr("*", "1L AS cluster", "'x' AS key", "2 AS point", "3 AS place")
    got = centroids.cluster(df)
    assert order(got.collect()) == order(plain(rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [0.5 * (i % 2)] * 64) for i in range(n)]
    out = centroids.cluster(frame(spark, rows))
    assert order(out.collect()) == order(plain(rows))
    assert out.dtypes[1] == ("cluster", "int")


def test_floor_of_negative_means(spark):
    rows = [(i, [-i / 64.0, i / 64.0]) for i in range(12)]
    out = centroids.cluster(frame(spark, rows), k=2, size=2)
    assert order(out.collect()) == order(plain(rows, k=2, size=2))


def test_query_equals_plain_clustering(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert order(op12_clusters(spark, DATA).collect()) == order(plain(rows))
