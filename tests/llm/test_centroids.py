import hashlib

import numpy as np
import pytest

from latentrank.llm.centroid_clusters import Bounds, arithmetic, centroid_clusters, centroid_groups, sums_by


def brute(rows, k, dims, scale, rounds, seed):
    """Lloyd's rounds as they are defined, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((key(i), v) for i, v in kept))[:k]]
    dist = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x))
    nearest = lambda v: min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        c = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(kept, own) if o == j))] if j in own else c[j] for j in range(len(c))]
    out = [(i, nearest(v)) for i, v in kept]
    return [(i, o, dist(v, c[o]), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, o), (_, v) in zip(out, kept)]


def sort_key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("shape", ["cloud", "heaps", "grid"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "cloud":
        x = rng.standard_normal((300, 4))
    elif shape == "heaps":  # many equal vectors, few distinct: empty clusters and ties
        x = rng.integers(0, 2, (300, 4)).astype(float)
        x[:120] = [1, 0, 1, 0]
    else:
        x = rng.integers(-2, 3, (300, 4)) / 1024.0
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(7, x[7].tolist()), (None, x[3].tolist()), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [1.0, float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = centroid_clusters(df, k=6, dims=4, rounds=5).collect()
    want = brute(rows, 6, 4, 1024, 5, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=sort_key) == sorted(want, key=sort_key)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    assert {(r.cluster, r.cluster_inertia) for r in got} == {(c, sum(w[2] for w in want if w[1] == c)) for c in {w[1] for w in want}}


def test_bounds_rule_out_and_stay_exact():
    rng = np.random.default_rng(0)
    v = np.floor(1024 * (rng.standard_normal((2000, 16)) + 4 * rng.integers(0, 3, (2000, 1))))
    c = v[:12].copy()
    groups = centroid_groups(c.astype(int), 4)
    bounds, scanned = Bounds.first(v, c, groups), []
    for _ in range(12):
        new = np.stack([v[bounds.own == j].mean(0) // 1 if (bounds.own == j).any() else c[j] for j in range(12)])
        drift = np.sqrt(((new - c) ** 2).sum(1)) * (1 + 1e-9)
        c = new
        bounds = Bounds.of(bounds.bytes(), len(v))
        scanned.append(len(bounds.moved(v, c, groups, drift)))
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (bounds.own == d.argmin(1)).all()
        assert (np.sqrt(d[np.arange(len(v)), bounds.own]) <= bounds.upper).all()
        d[np.arange(len(v)), bounds.own] = np.inf
        assert all((bounds.lower[:, g] <= np.sqrt(d[:, m].min(1)) + 1e-9).all() for g, m in enumerate(groups))
    assert scanned[-1] < 0.5 * len(v)


def test_wide_numbers_are_exact(spark):
    rows = [(i, [float(2.0**44 * (i % 5)) + i, float(i)]) for i in range(40)]
    with pytest.raises(ValueError):
        centroid_clusters(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), dims=2)
    rows = [(i, [float(2.0**15 * (i % 5)) + i, float(i)]) for i in range(40)]  # beyond float64's whole numbers once squared
    got = centroid_clusters(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3, dims=2, rounds=4).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == sorted(brute(rows, 3, 2, 1024, 4, 3))
    assert arithmetic(1 << 20, 64) is np.float64 and arithmetic(1 << 25, 64) is np.int64


def test_few_or_no_vectors_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 3, "a"), (2, [0.0, 0.0], 4, "b"), (2, [0.0, 0.0], 4, "b")], "vec_id bigint, embedding array<float>, cluster int, block string")
    got = centroid_clusters(df, k=8, dims=2).collect()
    assert len(got) == 3 and {r.distance for r in got} == {0}
    assert centroid_clusters(df.where("false"), dims=2).collect() == []
    assert centroid_clusters(df, dims=64).count() == 0


def test_sums_by_owner():
    v, own = np.arange(12).reshape(4, 3), np.array([1, 0, 1, 1])
    assert sums_by(v, own, 3).tolist() == [[1, 3, 4, 5], [3, 15, 18, 21], [0, 0, 0, 0]]
