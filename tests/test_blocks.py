"""Blocks of candidates: rings around pivots give the same winners, and far rings are never read."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from veilwork.operators import blocks
from veilwork.operators import joins as j

KIND = "id long, label int, embedding array<float>"


def clustered(rng, n, centres):
    at = rng.integers(0, len(centres), n)
    return (centres[at] + rng.normal(size=(n, centres.shape[1]))).astype(np.float32), at


def rows(x, labels, first=0):
    return [(first + i, None if label < 0 else int(label), v.tolist()) for i, (v, label) in enumerate(zip(x, labels))]


def brute(private, cand, q, rule, far):
    out = set()
    for i, label, e in private:
        mine = [(k, np.sqrt(((np.array(e, np.float32).astype(float) - np.array(c, np.float32)) ** 2).sum())) for k, other, c in cand if rule == "all" or (other == label) == (rule == "same")]
        mine.sort(key=lambda x: (-x[1] if far else x[1], x[0]))
        out |= {(i, k, r + 1) for r, (k, _) in enumerate(mine[:q])}
    return out


@pytest.mark.parametrize("rule,far", [("all", False), ("same", False), ("other", False), ("same", True), ("all", True)])
def test_rings_give_the_winners_of_brute_force(spark, rule, far):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 20
    x, at = clustered(rng, 400, centres)
    x[50:90] = x[50]  # a group of copies that is larger than a block
    cand = rows(x, rng.integers(-1, 3, 400))
    x, at = clustered(rng, 90, centres)
    private = rows(x, rng.integers(-1, 3, 90), 10_000) + [(20_000, 1, None)]
    found = j.knn(spark.createDataFrame(private, KIND).repartition(3), spark.createDataFrame(cand + [(9999, 1, None)], KIND), 3, rule, far, block=40)
    assert {(r.id, r.cand_id, r["rank"]) for r in found.collect()} == brute(private[:-1], cand, 3, rule, far)


def test_private_rows_move_once_and_candidates_not_at_all(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    plan = j.knn(e, e, 2, block=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Generate " not in plan and plan.count("Scan parquet") == 1
    plan = j.knn(e, e, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan


def test_far_rings_are_not_read():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 50
    x, at = clustered(rng, 4000, centres)
    x = x.astype(float)
    tables, label, pivot, inner, outer = [], [], [], [], []
    for p in range(20):
        of = np.flatnonzero(at == p)
        reach = np.sqrt(((x[of] - centres[p]) ** 2).sum(1))
        for part in np.array_split(of[np.argsort(reach)], 4):
            r = np.sqrt(((x[part] - centres[p]) ** 2).sum(1))
            tables.append(pa.table({"id": part, "label": np.zeros(len(part), np.int64), "embedding": list(x[part])}))
            pivot.append(p), inner.append(r.min() - 1e-9), outer.append(r.max() + 1e-9), label.append(-1)
    rings = blocks.Rings([str(i) for i in range(80)], *map(np.array, (label, pivot, inner, outer)), False, centres)
    mine = centres[3] + rng.normal(size=(200, 16))
    dist, ids = blocks.visit(mine, np.zeros(200), rings, lambda a, own, c: j._winners(a, own, c, 2, "all", False), 2, False, lambda f: tables[int(f)])
    exact = np.sqrt(((mine[:, None] - x) ** 2).sum(2))
    assert (ids == np.argsort(exact, axis=1, kind="stable")[:, :2]).all() and np.allclose(dist, np.sort(exact, axis=1)[:, :2])
    assert rings.counts == {"read": 4, "skipped": 76}  # the rings of the rows' own pivot, of 80


def test_the_way_without_readable_files(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cand, private = rows(rng.normal(size=(150, 4)), rng.integers(0, 3, 150)), rows(rng.normal(size=(40, 4)), rng.integers(0, 3, 40), 500)
    assert blocks.readable("file:///tmp/x") and not any(map(blocks.readable, ("viewfs://x/y", "odd://z")))
    monkeypatch.setattr(blocks, "readable", lambda uri: False)
    for rule, far in (("same", False), ("all", True)):
        found = j.knn(spark.createDataFrame(private, KIND), spark.createDataFrame(cand, KIND), 2, rule, far, block=30)
        assert {(r.id, r.cand_id, r["rank"]) for r in found.collect()} == brute(private, cand, 2, rule, far)


def test_memory_of_a_search_does_not_grow_with_the_number_of_blocks():
    rng = np.random.default_rng(4)
    n = 3000
    x, c = rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
    tables = {str(i): pa.table({"id": [i], "label": [i % 3], "embedding": [c[i]]}) for i in range(n)}
    pivots = c[:8]
    reach = np.sqrt(((c - pivots[np.arange(n) % 8]) ** 2).sum(1))
    rings = blocks.Rings(list(tables), *map(np.array, (np.arange(n) % 3, np.arange(n) % 8, reach - 1e-9, reach + 1e-9)), True, pivots)
    tracemalloc.start()
    dist, ids = blocks.visit(x, np.arange(n) % 3, rings, lambda a, own, t: j._winners(a, own, t, 1, "same", True), 1, True, lambda f: tables[f])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.where(np.arange(n)[:, None] % 3 == np.arange(n) % 3, np.sqrt(((x[:, None] - c) ** 2).sum(2)), -1)
    assert (ids[:, 0] == exact.argmax(1)).all() and np.allclose(dist[:, 0], exact.max(1))
    assert most < 8 * n * n / 10  # a tenth of one number for each row and block


def test_small_blocks_grow_with_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MANY_BLOCKS", 8)
    rng = np.random.default_rng(5)
    cand, private = rows(rng.normal(size=(600, 4)), rng.integers(0, 3, 600)), rows(rng.normal(size=(30, 4)), rng.integers(0, 3, 30), 1000)
    frame = j._plain(spark.createDataFrame(cand, KIND))
    assert len(blocks.store_rings(frame, 2, True).files) < 40  # 300 files of 2 rows before
    found = j.knn(spark.createDataFrame(private, KIND), spark.createDataFrame(cand, KIND), 2, "same", False, block=4)
    assert {(r.id, r.cand_id, r["rank"]) for r in found.collect()} == brute(private, cand, 2, "same", False)
