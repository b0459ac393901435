"""Fusion rounds in sequence, contrast prompts, and the corpus report against numpy."""

import numpy as np
from pyspark.sql import functions as F

from veilwork.cases import plans as cases
from veilwork.cases._case import split_embeddings
from veilwork.operators import aggregates as a
from veilwork.plans import rounds


def test_two_fusion_rounds_and_a_round_again(spark, sf, tmp_path):
    private, cand = split_embeddings(spark, sf)
    first = cases.with_text(spark, sf, cand)
    run = lambda start, n: rounds.fusion_rounds(
        private, first, cases._stand_in_scores, cases._answers, cases._directions, n, 50, 3, 0.5, "s", str(tmp_path / "rows"), start, k=6, variants=2
    )
    rows = run(1, 2).toPandas()
    assert rows.groupby("round").size().to_dict() == {0: cand.count(), 1: 50, 2: 50} and rows.id.is_unique
    assert set(rows[rows["round"] > 0].source_model) <= set(rows[rows["round"] == 0].source_model)
    quota = {r.source_model: r.quota for r in rounds.fusion_round(private, first, cases._stand_in_scores(first), 50, 3, 0.5, "s:1")["quota"].collect()}
    assert rows[rows["round"] == 1].groupby("source_model").size().to_dict() == {k: v for k, v in quota.items() if v}
    again = run(2, 1).toPandas()
    key = ["round", "id", "source_model", "label", "text"]
    assert again[key].sort_values(key).values.tolist() == rows[key].sort_values(key).values.tolist()


def test_contrast_prompts_show_bad_then_good(spark):
    votes = lambda base: spark.createDataFrame([(label, base + 10 * label + i, float(9 - i)) for label in (0, 1) for i in range(8)], "label int, cand_id long, votes double")
    texts = spark.createDataFrame([(i, f"text{{{i}}}") for i in range(300)], "id long, text string")
    got = {r.prompt_id: r for r in rounds.contrast_prompts(votes(100), votes(200), texts, "Write.", 5, 4, "s").collect()}
    assert sorted(got) == list(range(8))
    shown = set()
    for r in got.values():
        head, *lines = r.prompt.split("\n")
        kinds = [x.split(":")[0] for x in lines]
        numbers = [int(x.rsplit("text", 1)[1]) for x in lines]
        assert head == "Write." and kinds == ["A bad example"] * 2 + ["A good example"] * 3
        assert all(200 + 10 * r.label <= n < 205 + 10 * r.label for n in numbers[:2]) and all(100 + 10 * r.label <= n < 105 + 10 * r.label for n in numbers[2:])
        shown.add(tuple(numbers))
    assert len(shown) > 4  # drawn anew


def test_corpus_report_against_numpy(spark):
    rng = np.random.default_rng(4)
    frame = lambda x, y, p: spark.createDataFrame([(i, int(k), e.tolist(), int(c), "t" * int(i % 7) if i % 5 else None) for i, (e, k, c) in enumerate(zip(x, y, p))], "id long, label int, embedding array<float>, party int, text string").repartition(3)
    x, y = (rng.normal(size=(n, 5)).astype(np.float32).astype(float) for n in (90, 140))
    x[3] = 0
    lx, ly, px, py = rng.integers(0, 3, 90), rng.integers(0, 4, 140), rng.integers(0, 6, 90), rng.integers(0, 6, 140)
    got = {r.metric: r.value for r in rounds.corpus_report(frame(x, lx, px), frame(y, ly, py), "party", "text").collect()}
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    u = unit(x)[np.linalg.norm(x, axis=1) > 0]
    cos = u @ u.T
    want = {"self_similarity": (cos.sum() - len(u)) / (len(u) * (len(u) - 1)), "syn_rows": 90, "real_rows": 140}
    want["syn_mean_length"] = np.mean([i % 7 for i in range(90) if i % 5])
    sizes = np.bincount(px)
    want |= {"syn_client_size_mean": sizes.mean(), "syn_client_size_std": sizes.std()}
    shared = [(x[lx == k], y[ly == k]) for k in range(3)]
    want["class_mean_distance"] = np.mean([((p.mean(0) - q.mean(0)) ** 2).sum() for p, q in shared])
    want["cross_l2"] = np.mean([np.sqrt(((p[:, None] - q) ** 2).sum(2)).mean() for p, q in shared])
    want["cross_cosine"] = np.mean([(unit(p[np.linalg.norm(p, axis=1) > 0]) @ unit(q).T).mean() for p, q in shared])
    s1, s2 = np.cov(x.T), np.cov(y.T)
    want["frechet"] = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1 + s2) - 2 * np.sqrt(np.maximum(np.linalg.eigvals(s1 @ s2).real, 0)).sum()
    assert all(np.isclose(got[k], v) for k, v in want.items()), {k: (got[k], v) for k, v in want.items()}
    assert {"mauve", "kl", "total_variation", "wasserstein", "frontier_integral"} <= set(got)


def test_side_sums_of_no_rows(spark):
    none = a.side_sums(spark.createDataFrame([], "label int, embedding array<float>"))
    assert none.n == 0 and none.self_similarity() is None and none.cross_cosine(none) is None and none.mean_length() is None
    half = a.side_sums(spark.createDataFrame([(1, [0.0, 1.0]), (None, [1.0, 0.0])], "label int, embedding array<float>").withColumn("x", F.lit(1)))
    assert half.n == 2 and half.self_similarity() == 0.0 and half.class_mean_distance(half) == 0.0
