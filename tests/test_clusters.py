"""Cluster histograms against a plain recursive twin over all rows at once."""

from collections import Counter

import numpy as np
import pytest

from veilwork.operators.clusters import cluster_histograms


def twin(a, b, clusters, steps=3, variance=0.9):
    x = np.concatenate([a, b]).astype(np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    w, q = np.linalg.eigh(np.cov(x.T))
    w, q = w[::-1], q[:, ::-1]
    x = x @ q[:, : np.searchsorted(np.cumsum(w) / w.sum(), variance) + 1]
    is_a = np.arange(len(x)) < len(a)
    found = []

    def grow(rows, leaves):
        part = x[rows]
        widest = part.var(0).argmax()
        up = part[:, widest] > part[:, widest].mean()
        if leaves == 1 or len(rows) == 1 or up.all() or not up.any():
            found.append((is_a[rows].sum() / len(a), (~is_a[rows]).sum() / len(b)))
            return
        for _ in range(steps):
            low, high = part[~up].mean(0), part[up].mean(0)
            again = ((part - high) ** 2).sum(1) < ((part - low) ** 2).sum(1)
            if again.all() or not again.any():
                break
            up = again
        first = min(max(int(leaves * (~up).sum() / len(rows) + 0.5), 1), leaves - 1)
        grow(rows[~up], first)
        grow(rows[up], leaves - first)

    grow(np.arange(len(x)), clusters)
    return Counter((round(p, 9), round(q, 9)) for p, q in found)


@pytest.mark.parametrize("local,clusters", [(20_000, None), (40, None), (40, 7), (1, 12)])
def test_histograms_equal_the_twin(spark, local, clusters):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    a, b = (centres[rng.integers(0, 8, n)] + 0.4 * rng.normal(size=(n, 12)) for n in (300, 220))
    b[100:180] = b[100]  # a third of a set are copies
    b[7] = 0
    frame = lambda x: spark.createDataFrame([(e.tolist(),) for e in x.astype(np.float32)] + [(None,)], "embedding array<float>").repartition(3)
    got = cluster_histograms(frame(a), frame(b), clusters=clusters, local=local).collect()
    assert Counter((round(r.p, 9), round(r.q, 9)) for r in got) == twin(a, b, clusters or 22)
    assert abs(sum(r.p for r in got) - 1) < 1e-9 and abs(sum(r.q for r in got) - 1) < 1e-9
