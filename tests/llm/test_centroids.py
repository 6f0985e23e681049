"""Shallot search against all distances measured."""

import hashlib
import math

import numpy as np
import pytest

from cohortlens.llm import centroids


def plain(rows, dims, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    cs = [list(v) for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    return sorted([(i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in out], key=str)


def run(spark, rows, **args):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    return sorted([tuple(r) for r in centroids.shallot_kmeans(df, **args).collect()], key=str)


@pytest.mark.parametrize("seed, blobs, rounds", [(1, 1, 3), (2, 7, 3), (3, 40, 5), (4, 3, 0)])
def test_plain(spark, seed, blobs, rounds):
    g = np.random.default_rng(seed)
    mid = g.normal(0, 1, (blobs, 6))
    rows = [(i, (mid[g.integers(blobs)] + g.normal(0, 0.2, 6)).astype(np.float32).tolist()) for i in range(600)]
    assert run(spark, rows, dims=6, k=12, rounds=rounds) == plain(rows, 6, 12, rounds)


def test_ties_repeats_nulls_and_unusable(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]  # many equal vectors and equal distances
    odd = [(100, None), (101, [1.0]), (102, [1.0, None]), (103, [math.nan, 0.0]), (104, [math.inf, 0.0]), (None, [2.0, 2.0]), (None, [0.5, -0.5]), (5, [2.0, 1.0]), (5, [2.0, 1.0])]
    assert run(spark, grid + odd, dims=2, k=8, rounds=3) == plain(grid + odd, 2, 8, 3)


def test_few_and_none(spark):
    assert run(spark, [(1, [0.1, -0.1]), (2, [-3.0, 4.0])], dims=2, k=16, rounds=3) == plain([(1, [0.1, -0.1]), (2, [-3.0, 4.0])], 2, 16, 3)
    assert run(spark, [(1, [0.1, -0.1])], dims=2, k=16, rounds=3) == plain([(1, [0.1, -0.1])], 2, 16, 3)
    assert run(spark, [], dims=2) == []
    assert run(spark, [(1, [1e30, 0.0])], dims=2) == []  # no long holds its distances
