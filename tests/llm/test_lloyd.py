import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import lloyd


def plain(rows, dims=64, k=16, rounds=3, scale=64):
    """Rows (id, x, cluster, distance) and centroids by comparing all vectors with all centroids in Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for turn in range(rounds + 1):
        near = [min((far(x, c), n) for n, c in enumerate(centroids)) for _, x in kept]
        if turn == rounds:
            break
        for n in range(len(centroids)):
            mine = [x for (_, x), (_, m) in zip(kept, near) if m == n]
            if mine:
                centroids[n] = [sum(column) // len(mine) for column in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, near)], centroids


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(9)]
    out = [(i, [c + rng.gauss(0, rng.choice([0.05, 1])) for c in rng.choice(centres)]) for i in range(300)]
    out += [(1000 + i, out[5][1]) for i in range(150)]  # one hot vector
    out += [(i, [float(i % 2)] * 64) for i in range(2000, 2030)]  # equally far from many
    bad = [(3000, None), (3001, []), (3002, [0.5] * 63), (3003, [0.5] * 65), (3004, [float("nan")] + [0.0] * 63), (3005, [float("inf")] * 64), (3006, [-float("inf")] * 64), (3007, [None] + [1.0] * 63)]
    return out + bad + [(None, [0.1] * 64), (None, [0.2] * 64), out[7], (8, out[9][1])]


@pytest.mark.parametrize("block", [7, 512])
def test_equals_plain_rounds(spark, rows, block):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as single precision has them
    want, centroids = plain(rows)
    got, values = lloyd.cluster(df, block=block)
    assert values == centroids
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_described(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, centroids = plain(rows)
    out = lloyd.described(*lloyd.cluster(df)).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [4.0, 4.0])], "vec_id long, embedding array<double>")
    got, values = lloyd.cluster(df, dims=2)
    assert len(values) == 3 and len({r.cluster for r in got.collect() if r.vec_id != 3}) == 1
    got = lloyd.described(*lloyd.cluster(df.limit(0), dims=2))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert lloyd.cluster(df)[0].count() == 0  # none has 64 components


def test_wide_numbers_and_names(spark):
    rng = random.Random(1)
    big = [(i, [rng.uniform(-2e6, 2e6) for _ in range(64)], "x", i) for i in range(60)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, cluster string, x long")
    want, _ = plain([r[:2] for r in big], k=5)
    got = lloyd.cluster(df, keep=["vec_id", "cluster", "x"], k=5)[0].collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want) and all(r.cluster_in == "x" and r.x == r.vec_id for r in got)
    with pytest.raises(Exception, match="may not fit a long"):
        lloyd.cluster(spark.createDataFrame([(1, [3e9] * 64)], "vec_id long, embedding array<double>"), rounds=0)[0].collect()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.sampled_from([1, 3, 40, 5_000_000]), st.integers(0, 10**6))
def test_trees_cover_and_find_the_nearest(n, k, spread, seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread + 1, (n, 3)), rng.integers(-spread, spread + 1, (k, 3))
    tree, order = lloyd.cover_tree(x)
    assert sorted(order) == list(range(n))
    y = x[order]
    for i in range(len(tree.point)):
        inside = y[tree.begin[i] : tree.begin[i] + tree.size[i]]
        assert ((inside - y[tree.point[i]]) ** 2).sum(1).max() == tree.radius2[i]
        kids = range(tree.first[i], tree.first[i] + tree.children[i])
        if tree.children[i]:
            assert sum(tree.size[j] for j in kids) == tree.size[i] and any((y[tree.point[j]] == y[tree.point[i]]).all() for j in kids)
            half = 2.0 ** (math.ceil(math.log2(math.sqrt(tree.radius2[i])) - 1e-12) - 1)
            centres = y[[tree.point[j] for j in kids]]
            assert all(((a - b) ** 2).sum() > half**2 for m, a in enumerate(centres) for b in centres[:m])
    now = lloyd.Centroids(c.tolist())
    label, d2 = now.of(tree, y)
    every = ((y[:, None].astype("i8") - c[None]) ** 2).sum(2)
    assert (label == every.argmin(1)).all() and (d2 == every.min(1)).all()
