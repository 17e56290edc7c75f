import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstroke.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every=1):
    best = {}
    for d, v in rows:
        if d is None or v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        best[d] = min(best.get(d, v), v)
    out = {}
    for d, v in best.items():
        others = sorted((sum((np.float32(x) - np.float64(np.float32(y))) ** 2 for x, y in zip(v, w)), e) for e, w in best.items() if e != d and len(w) == len(v) and len(v))
        out[d] = [(e, round(math.sqrt(x), 5)) for x, e in others[:k]]
    return {d: x for d, x in out.items() if x and d % every == 0}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbour_id, round(r.distance, 5)))
    return out


@pytest.mark.parametrize("tile_rows, every, sample", [(1024, 1, 4096), (60, 1, 50), (30, 50, 4096), (1024, 6, 5)])
def test_equal_to_brute_force(spark, monkeypatch, tile_rows, every, sample):
    monkeypatch.setattr(T, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(T, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(T, "QUERIES", 64)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(220, 40)) * np.geomspace(3, 0.05, 40)
    v[100:110] = v[90]  # ties
    v[200:] = v[:20] + 1e-3
    rows = [(i * 3, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    a, b = got(T.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), every=every)), brute(rows, T.K, every)
    assert a.keys() == b.keys()
    for d in b:
        assert [e for e, _ in a[d]] == [e for e, _ in b[d]]
        assert np.allclose([x for _, x in a[d]], [x for _, x in b[d]], atol=2e-5)


def test_defined_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]), (8, [1.0]), (9, [2.0]), (10, []), (None, [0.0, 0.0]), (11, [5.0, 5.0, 5.0])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    for name in ("tile", "dims", "rank", "distance", "pair", "base"):
        vectors = vectors.withColumn(name, F.lit("x"))
    assert got(T.nearest(vectors, every=1)) == {1: [(2, 1.0), (3, 1.0)], 2: [(1, 1.0), (3, round(math.sqrt(2), 5))], 3: [(1, 1.0), (2, round(math.sqrt(2), 5))], 8: [(9, 1.0)], 9: [(8, 1.0)]}
    assert got(T.nearest(vectors)) == {} and T.nearest(vectors.limit(0)).count() == 0


def test_wide_vectors_and_tiles_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE_BYTES", 1 << 20)
    monkeypatch.setattr(T, "SAMPLE_BYTES", 1 << 20)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 3000)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    a = got(T.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert a.keys() == {0, 50, 100, 150, 200, 250}
    for d, near in a.items():
        far = ((v.astype(float) - v[d]) ** 2).sum(1)
        far[d] = np.inf
        assert [e for e, _ in near] == np.argsort(far)[:10].tolist()


def test_bounds_prune_most_candidates():
    """Of clustered vectors few survive to the exact distances, with the bound that a query brings."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 64)) * 4
    v = (centre[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 64))).astype(np.float32)
    ids = np.arange(8000)
    q = np.ascontiguousarray(v[:64].T)
    limits = T.bounds(ids[:64], q, ids[::4], np.ascontiguousarray(v[::4].T), 10)
    found = T.search(ids[:64], q, limits, ids, np.ascontiguousarray(v.T))
    far = ((v[:64, None].astype(float) - v) ** 2).sum(2)
    far[np.arange(64), np.arange(64)] = np.inf
    want = np.argsort(far, axis=1)[:, :10]
    assert np.array_equal(found[1].reshape(64, 10), want) and (limits >= np.sort(far, axis=1)[:, 9] - 1e-6).all()
