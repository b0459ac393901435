"""Hard-negative mining against brute force, exact scores and edge rows."""

import math
import random

import numpy as np
import pytest

from veilwork.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, id string, score double"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    seen = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], c)
        for i, v, c, *_ in rows
        if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, done = [], set()
    for a, v, c in seen:
        if a % every or (a, tuple(v), c) in done:
            continue
        done.add((a, tuple(v), c))
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, w, d in seen if j != a)
        for p, i, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [x for x in scored if x[2] != c and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **options).collect()))


@pytest.mark.parametrize("seed,dims,block", [(1, 8, 4096), (2, 13, 2), (3, 64, 3)])
def test_equals_brute_force_with_ties_and_a_hot_label(spark, seed, dims, block):
    rng = random.Random(seed)
    vectors = [[rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0, rng.random()]) for _ in range(dims)] for _ in range(60)]
    rows = [(i * 5, rng.choice(vectors), rng.choice([0, 0, 0, 1, 2, -3]), "x", 1.0) for i in range(300)]
    want = brute(rows)
    assert want and found(spark, rows, block=block, together=(16, 3)) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (100, [1.0], 1), (1, [1.0, 0.25, 9.0], 1), (2, [0.5, 0.5], 2), (3, [0.5], 2), (3, [0.5], 2), (0, [1.0, 0.5], 1)]
    bad = [(4, None, 1), (5, [1.0, None], 1), (6, [nan], 1), (7, [1.0, inf], 1), (8, [1.0], None), (None, [1.0], 1), (9, [], 2), (200, [], 5)]
    rows = [(*r, "clash", None) for r in good + bad]
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1, "", 0.0)]) == []


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(5)
    for width in (1, 9, 12, 28):
        a, x = (rng.integers(-(2 ** (width - 1)), 2 ** (width - 1), (n, 21)) for n in (7, 40))
        padded = np.pad(x, ((0, 0), (0, 3)))
        got = hard_negatives.scores(hard_negatives.bit_planes(padded), hard_negatives.subset_sums(a, int(np.abs(x).max())))
        assert (got == x @ a.T).all()


def test_huge_components_are_held(spark):
    rows = [(0, [3e38, -3e38], 1, "", 0.0), (1, [3e38, 1.0], 1, "", 0.0), (2, [1.0, 0.0], 2, "", 0.0)]
    got = found(spark, rows, low=0)
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in got] == [(0, 1, 2, 2**54 - 256 * 2**27, 256 * 2**27)]
