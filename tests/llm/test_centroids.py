"""Yinyang k-means against plain k-means with Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from pathloom.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, cluster string, x string, `a.b` string"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(np.float32(y))) for y in v]) for i, v in rows if v is not None and len(v) == dims and all(y is not None and math.isfinite(y) for y in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    heads = [x for _, x in sorted(kept, key=mark)[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min(range(len(heads)), key=lambda i: (far(x, heads[i]), i))
    for _ in range(rounds):
        own = [nearest(x) for _, x in kept]
        sets = [[x for (_, x), o in zip(kept, own, strict=True) if o == i] for i in range(len(heads))]
        heads = [[sum(y) // len(s) for y in zip(*s, strict=True)] if s else h for s, h in zip(sets, heads, strict=True)]
    out = [(i, nearest(x), far(x, heads[nearest(x)]), hashlib.sha256(",".join(map(str, heads[nearest(x)])).encode()).hexdigest()) for i, x in kept]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_kmeans(spark, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(a + rng.gauss(0, 0.6), 1 if seed else 3) for a in rng.choice(middles)]) for i in range(400)]
    rows += [rows[3]] * 60 + [(None, rows[4][1]), (900, None), (901, [1.0]), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, "q", "q", "q") for i, v in rows], SCHEMA).repartition(5)
    got = c.cluster(df, k=8, rounds=7, dims=6).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got), key=str) == plain(rows, 8, 7, 6)
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for r in got:
        assert r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"])


def test_few_vectors_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = c.cluster(df, dims=2).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in got] == [(0, 0, 0)] * 3  # equal centroids: the smallest number
    none = c.cluster(df.where("vec_id > 5"), dims=2)
    assert none.count() == 0 and none.columns == c.cluster(df, dims=2).columns


def test_components_too_large_raise(spark):
    df = spark.createDataFrame([(1, [1e9, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leave a long"):
        c.cluster(df, dims=2).collect()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (16, 8))
    x = middles[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    heads = x[:16].copy()
    group = c.grouped(heads)
    own, upper, lower, moved, spent, rounds = np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), group.max() + 1)), np.zeros(16), 0, 12
    for _ in range(rounds):
        own, upper, lower, n = c.moved_bounds(x, own, upper, lower, heads, moved, group)
        assert (own == c.squared(x, heads).argmin(1)).all()
        spent += n
        new = np.array([x[own == i].sum(0) // (own == i).sum() if (own == i).any() else heads[i] for i in range(16)])
        moved, heads = c._above(((new - heads) ** 2).sum(1)), new
    assert spent < 0.5 * rounds * 16 * len(x)
