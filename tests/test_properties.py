"""Properties of random and iterative operators, independent computations, and hand-made edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions import keyed
from veilwork.functions import text as t
from veilwork.functions import vectors as v
from veilwork.operators import aggregates as a
from veilwork.operators import filters as f
from veilwork.operators import joins as j
from veilwork.operators import overlap
from veilwork.operators import sampling as m
from veilwork.operators import selection as s
from veilwork.operators import sets
from veilwork.operators.elite import diverse_elite, walk
from veilwork.plans import hooks


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, embedding array<float>")


def test_keyed_draws_do_not_depend_on_partitions(spark):
    df = spark.range(2000)
    one = df.repartition(1).select("id", keyed.uniform("k", F.col("id")).alias("u"))
    seven = df.repartition(7).select("id", keyed.uniform("k", F.col("id")).alias("u"))
    assert one.exceptAll(seven).count() == 0
    x = np.array([r[0] for r in df.select(keyed.gaussian("k", F.col("id"), bits=52)).collect()])
    assert abs(x.mean()) < 0.08 and abs(x.std() - 1) < 0.06


def test_nearest_breaks_ties_by_id_and_skips_null(spark):
    c = vectors(spark, [(5, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (9, 1, [0.0, 0.0])])
    p = vectors(spark, [(1, 0, [1.0, 0.1]), (2, 1, [0.0, 0.0]), (4, 0, None)])
    assert {(r.id, r.cand_id) for r in j.nearest(p, c).collect()} == {(1, 3), (2, 9)}
    assert {(r.id, r.cand_id) for r in j.knn(p, c, 1, block=2).collect()} == {(1, 3), (2, 9)}


def test_votes_keep_empty_bins_and_noise_reaches_them(spark):
    c = vectors(spark, [(i, 0, [float(i)]) for i in range(5)])
    p = vectors(spark, [(10, 0, [0.1])])
    hist = a.vote_histogram(j.nearest(p, c), c)
    assert hist.count() == 5 and hist.agg(F.sum("votes")).first()[0] == 1
    noisy = a.noisy_votes(hist, 1.0, "secret")
    assert noisy.filter("votes = 0").count() == 0


def test_probability_of_all_zero_votes_is_uniform(spark):
    h = spark.createDataFrame([(i, 0.0) for i in range(4)], "cand_id long, votes double")
    assert [round(r.p, 6) for r in a.to_probability(h).collect()] == [0.25] * 4
    with pytest.raises(ValueError):
        m.weighted_resample(spark.createDataFrame([(1, 0.0)], "id long, w double"), 3, "k")


def test_cosine_of_a_zero_vector_is_null(spark):
    df = vectors(spark, [(1, 0, [0.0, 0.0])])
    assert df.select(v.cosine(F.col("embedding"), F.col("embedding"))).first()[0] is None


def test_frechet_and_moments(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(1, 2, size=(50, 3))
    frame = lambda z: vectors(spark, [(i, 0, row.tolist()) for i, row in enumerate(z)])
    x, y = x.astype(np.float32), y.astype(np.float32)
    n, mean, cov = a.moments(frame(x).repartition(3))
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    s1, s2 = np.cov(x.T), np.cov(y.T)
    roots = np.sqrt(np.maximum(np.linalg.eigvals(s1 @ s2).real, 0)).sum()
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * roots
    assert math.isclose(a.frechet(frame(x), frame(y)), want, rel_tol=1e-6)


def test_budget_of_the_published_settings(spark):
    def eps(sigma, steps, delta):
        q = spark.createDataFrame([(sigma,)] * steps, "sigma double")
        return a.budget_ledger(q, delta).first()["epsilon"]

    assert abs(eps(11.3, 11, 3e-6) - 1.2875) < 1e-3
    assert abs(eps(2.31, 11, 3e-6) - 7.5790) < 1e-3
    assert abs(eps(3.35, 20, 0.45) - 0.9924) < 1e-3


def test_elite_walk_matches_the_plain_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    taken, thr, free = [], 0.1, list(range(40))
    while len(taken) < 12:
        for i in list(free):
            if len(taken) < 12 and all(unit[i] @ unit[k] < thr for k in taken):
                taken.append(i)
                free.remove(i)
        if len(taken) < 12:
            thr += 0.01
    assert walk(x, 12, 0.1)[0] == taken
    assert len(walk(np.ones((3, 2)), 5, 0.5)[0]) <= 3


@pytest.mark.parametrize("k", [1, 3])
def test_client_partitions_place_each_row_once(spark, k):
    df = spark.range(120).withColumn("label", F.col("id") % 4)
    for out in (
        m.iid_clients(df, k, "k"),
        m.dirichlet_clients(df, k, 0.5, 1, min_size=5),
        m.dirichlet_clients_pinned(df, k, 0.5, 1, 120 // k + 1),
        m.fixed_size_clients(df, 30, 0.5, 1),
        m.class_skew_clients(df, k, 2, "k"),
    ):
        assert out.count() == 120 and out.select("id").distinct().count() == 120
    capped = m.dirichlet_clients_pinned(df, 3, 0.2, 1, 41).groupBy("client_id").count()
    assert capped.agg(F.max("count")).first()[0] <= 41
    sizes = m.fixed_size_clients(df, 30, 0.5, 1).groupBy("client_id").count().orderBy("client_id").collect()
    assert all(r["count"] == 30 for r in sizes[:-1])


def test_resample_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id long, w double")
    n = {r.id: r["count"] for r in m.weighted_resample(df, 4000, "k").groupBy("id").count().collect()}
    assert 3 not in n and sum(n.values()) == 4000 and abs(n[2] / 4000 - 0.75) < 0.03


def test_resample_with_one_heavy_row_and_many_light_ones(spark):
    w = [1.0 if i % 3 else 0.0 for i in range(3000)]
    w[1501] = 60_000.0
    df = spark.createDataFrame(list(enumerate(w)), "id long, w double").repartition(7)
    got = m.weighted_resample(df, 5000, "k")
    ends = np.cumsum(w)
    x = [(r.draw, r.u * ends[-1]) for r in spark.range(5000).select(F.col("id").alias("draw"), keyed.uniform("k", F.col("id"), "draw").alias("u")).collect()]
    want = {draw: int(np.searchsorted(ends, at, side="right")) for draw, at in x}
    assert {r.draw: r.id for r in got.collect()} == want and sum(v == 1501 for v in want.values()) > 4500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("parts", [1, 9])
def test_merged_draws_take_the_last_row_before(spark, parts):
    rng = np.random.default_rng(6)
    at = np.sort(rng.random(40)) * 10
    rows = spark.createDataFrame([(f"k{i}", float(x)) for i, x in enumerate(at)], "key string, at double")
    draws = [(i, float(x)) for i, x in enumerate(np.r_[rng.random(500) * 2 + 4, at[:5], -1.0])]
    got = {r.draw: r.key for r in s.last_before(rows.repartition(parts), spark.createDataFrame(draws, "draw long, at double").repartition(parts)).collect()}
    assert got == {i: f"k{np.searchsorted(at, x, side='right') - 1}" for i, x in draws if x >= at[0]}


def test_prefix_sums_and_correlation_against_numpy(spark):
    import pandas as pd

    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 6, 900).astype(float), rng.normal(size=900).round(1)
    x[:300] = 2.0  # a third of the rows share a value
    rows = [(float(p), float(q)) for p, q in zip(x, y)]
    got = a.correlation(spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "a double, b double").repartition(5), "a", "b").first()
    want = pd.DataFrame({"a": x, "b": y})
    assert np.isclose(got.pearson, want.corr().iloc[0, 1]) and np.isclose(got.spearman, want.rank().corr().iloc[0, 1])
    constant = a.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert constant.pearson is None and constant.spearman is None
    assert a.correlation(spark.createDataFrame([], "a double, b double"), "a", "b").first().pearson is None
    sums = s.prefix_sums(spark.createDataFrame([(i, i % 7) for i in range(500)], "k long, w long").repartition(6), "k", "w").orderBy("k").collect()
    assert [r.before for r in sums] == list(np.r_[0, np.cumsum([i % 7 for i in range(499)])]) and [r.previous for r in sums] == [None, *range(499)]
    hist = spark.createDataFrame([(float(p), float(q)) for p, q in rng.random((300, 2)).round(2)], "p double, q double")
    p, q = np.sort([r.p for r in hist.collect()]), np.sort([r.q for r in hist.collect()])
    assert np.isclose(a.histogram_distances(hist).first().wasserstein, np.abs(p - q).mean())
    for plan in (a.correlation(hist, "p", "q"), a.histogram_distances(hist)):
        for line in plan._jdf.queryExecution().executedPlan().toString().splitlines():
            assert "Window" not in line or "__part" in line  # only over a row for each task


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert s.reindex(df, ["doc_id"]).count() == 0
    assert sets.exact_dedup(df, ["text"], "doc_id").count() == 0
    assert f.min_words(df, 3).count() == 0
    assert a.classification_report(spark.createDataFrame([], "label int, pred int")).first()["accuracy"] is None


def test_dedup_with_null_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "")], "doc_id long, text string")
    assert {r.doc_id for r in sets.exact_dedup(df, ["text"], "doc_id").collect()} == {1, 3, 5}


def test_cutting_rejects_text_without_any_mark(spark):
    df = spark.createDataFrame([('say "x"',), ("one\ntwo",), ("a b. c",), ("plain",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(t.cut_output(F.col("x"))).collect()]
    assert got == ["say", "one", "a b.", None, None, None]


def test_answer_outside_every_window(spark):
    df = spark.createDataFrame([(0, 8, 20, 21), (0, 8, 2, 3), (0, 8, None, None)], "s int, n int, f int, l int")
    a_, b_ = t.align_answer_span(F.col("s"), F.col("n"), F.col("f"), F.col("l"))
    assert [tuple(r) for r in df.select(a_, b_).collect()] == [(0, 0), (2, 3), (0, 0)]


def test_ties_in_ranks_and_equal_scores(spark):
    df = spark.createDataFrame([("q", i, 0.5, f"r{i}") for i in range(4)], "prompt string, pos int, score double, text string")
    r = s.rank_in_prompt(df, 2).first()
    assert (r.chosen, r.rejected) == ("r0", "r2")
    c = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0)], "id long, label string, score double")
    assert m.exponential_pick(c, 1.0, 1.0, "k").count() == 1


def test_rouge_of_short_texts(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"]), (2, [], ["a"]), (3, ["a", "b", "c"], ["a", "c"])], "id long, cand array<string>, ref array<string>")
    got = {r.id: r.rouge_l for r in overlap.pair_rouge(df).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and math.isclose(got[3], 0.8)


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "prompt_id long, prompt string")
    e = hooks.embed(df, lambda: lambda texts: [[len(x), 1] for x in texts], "prompt").orderBy("prompt_id").collect()
    assert [list(r.embedding) for r in e] == [[3.0, 1.0], [0.0, 1.0]]
    g = hooks.generate(df, lambda: lambda p: [] if p is None else [p, p]).count()
    assert g == 2
    q = spark.createDataFrame([("q", "r")], "question string, response string")
    assert hooks.score(q, lambda: lambda x, y: (1.0, 2.0)).first()["ppl"] == 2.0


def test_plans_have_no_cartesian_product(spark):
    p = vectors(spark, [(1, 0, [1.0])])
    plan = j.nearest(p, p)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("n,pool,threshold", [(6, 1, 0.1), (6, 2, 0.5), (40, 1, 0.9), (3, 10, 0.2)])
def test_elite_beyond_the_first_block_matches_the_walk(spark, n, pool, threshold):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        near = np.array([1.0, 0, 0, 0]) + 0.01 * rng.normal(size=(20, 4))
        x = np.concatenate([near, near[:4], rng.normal(size=(15, 4))]).astype(np.float32)
        rows += [(100 * (label or 0) + (label is None) * 1000 + i, label, float(100 - i // 2), e.tolist()) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, votes double, embedding array<float>").repartition(5)
    want = set()
    for label in (0, 1, None):
        mine = sorted((r for r in rows if r[1] == label), key=lambda r: (-r[2], r[0]))
        taken, last = walk(np.array([r[3] for r in mine]), n, threshold)
        want |= {(label, mine[i][0], p + 1, round(last, 6)) for p, i in enumerate(taken)}
    got = [tuple(r) for r in diverse_elite(df, n, threshold, pool).collect()]
    assert set(got) == want and len(got) == len(want)
    assert diverse_elite(df.limit(0), n, threshold, pool).count() == 0


def test_elite_of_a_hundred_thousand_rows_of_a_class(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 6))
    x = (centres[np.sort(rng.integers(0, 30, 100_000))] + 0.05 * rng.normal(size=(100_000, 6))).astype(np.float32)  # runs of like rows
    spark.sparkContext.setLogLevel("ERROR")
    df = spark.createDataFrame([(i, 1, float(-i), e.tolist()) for i, e in enumerate(x)], "id long, label int, votes double, embedding array<float>")
    taken, last = walk(x.astype(float), 24, 0.3)
    got = sorted((r.place, r.id, r.threshold) for r in diverse_elite(df, 24, 0.3).collect())
    assert got == [(p + 1, i, round(last, 6)) for p, i in enumerate(taken)]


@pytest.mark.parametrize("rule,far", [("all", False), ("same", False), ("other", False), ("same", True)])
def test_knn_keeps_the_smallest_ids_of_many_copies(spark, rule, far):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(4, 16)) + 5).astype(np.float32)
    cand = [(int(i), k % 2, base[k % 4].tolist()) for k, i in enumerate(rng.permutation(800))]
    priv = [(1000 + i, i % 2, (base[i % 4] + rng.normal(size=16).astype(np.float32) * 0.1).tolist()) for i in range(12)]
    want = set()
    for i, label, e in priv:
        ok = [x for x in cand if rule == "all" or (x[1] == label) == (rule == "same")]
        dist = {x[0]: float(np.sqrt(((np.array(e, np.float32).astype(float) - np.array(x[2], np.float32)) ** 2).sum())) for x in ok}
        want |= {(i, x) for x in sorted(dist, key=lambda x: (-dist[x] if far else dist[x], x))[:3]}
    for block in (j.BLOCK, 300):
        got = j.knn(vectors(spark, priv), vectors(spark, cand), 3, rule, far, block)
        assert {(r.id, r.cand_id) for r in got.collect()} == want


def test_weight_update_by_hand(spark):
    theta = spark.createDataFrame([(0, 0, 1.0, False), (0, 1, 2.0, False), (0, 2, 1.0, True), (0, 3, 3.0, True)], "source_model long, idx long, theta double, is_real boolean")
    rows = [(0, 0, 0, [0.7, 0.3]), (0, 0, 1, [0.4, 0.6]), (0, 0, 2, [0.9, 0.1]), (0, 0, 3, [0.2, 0.8])]
    scores = spark.createDataFrame([(m, s, i, 0, p, int(p[1] > p[0])) for m, s, i, p in rows], "model_id long, source_model long, idx long, label int, prob array<double>, pred int")
    factor = [0.5**0.3, 0.5**-0.6, 0.5**0.1, 0.5**-0.8]  # a wrong row grows
    want = [t * f for t, f in zip([1, 2, 1, 3], factor)]
    want = [w * 7 / sum(want) for w in want]
    got = {r.idx: r.theta for r in a.weight_update(theta, scores, 0.5).collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in enumerate(want))
    odds = (1 * 0.1 + 3 * 0.8) / 4
    odds = odds / (1 - odds)
    odds = 1 / odds if odds > 1 else odds
    want = [0.5**0.3, 2 * 0.5**-0.6, odds**-0.1, 3 * odds**-0.8]
    want = [w * 7 / sum(want) for w in want]
    got = {r.idx: r.theta for r in a.weight_update(theta, scores, 0.5, real="is_real").collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in enumerate(want))


def test_weight_update_without_own_sources_keeps_every_row(spark):
    theta = spark.createDataFrame([(0, 0, 1.0, False), (0, 1, 2.0, True), (1, 0, 1.0, False), (1, 1, 4.0, False)], "source_model long, idx long, theta double, is_real boolean")
    rows = [(1, 0, 0, [0.7, 0.3]), (1, 0, 1, [0.4, 0.6]), (0, 1, 0, [0.2, 0.8]), (0, 0, 0, [0.1, 0.9]), (1, 1, 1, [0.5, 0.5])]  # row (1, 1) has no other model's score
    scores = spark.createDataFrame([(m, s, i, 0, p, int(p[1] > p[0])) for m, s, i, p in rows], "model_id long, source_model long, idx long, label int, prob array<double>, pred int")
    want = {(0, 0): 0.5**0.3, (0, 1): 2 * (0.4 / 0.6) ** -0.6, (1, 0): 0.5**-0.8, (1, 1): 4.0}
    total = {0: 3 / (want[0, 0] + want[0, 1]), 1: 5 / (want[1, 0] + want[1, 1])}
    got = {(r.source_model, r.idx): r.theta for r in a.weight_update(theta, scores, 0.5, real="is_real", scope="other").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - w * total[k[0]]) < 1e-12 for k, w in want.items())
    one = a.weight_update(theta.filter("source_model = 0"), scores, 0.5, scope="other").collect()  # a single source is judged by all
    assert {r.idx for r in one} == {0, 1}


def test_client_scores_without_clipping_are_the_mean_similarity(spark):
    sim = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 1.0), ("b", 2, 5.0)], "party string, cand_id long, similarity double")
    assert {r.cand_id: r.score for r in a.client_scores(sim, clip=False).collect()} == {1: 1.5, 2: 4.5}


def test_exact_dedup_keeps_rows_that_only_look_alike(spark):
    from veilwork.operators import sets

    rows = [(1, "a\x1f", "b"), (2, "a", "\x1fb"), (3, None, "c"), (4, "\x00", "c"), (5, None, "c"), (6, "1:a", ""), (7, "1", ":a")]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    assert sorted(r.id for r in sets.exact_dedup(df, ["x", "y"], "id").collect()) == [1, 2, 3, 4, 6, 7]


@pytest.mark.parametrize("pool,k", [(20, 20), (5, 5), (40, 3)])
def test_few_shots_are_never_short(spark, pool, k):
    from veilwork.operators import sampling

    prompts = spark.range(300).withColumnRenamed("id", "prompt_id")
    got = sampling.few_shot_ids(prompts, pool, k, "s").toPandas()
    assert (got.groupby("prompt_id").position.nunique() == k).all() and got.prompt_id.nunique() == 300


def test_skewed_quotas(spark):
    from veilwork.operators import sampling

    for seed in range(20):
        q = sampling.skewed_quotas({"a": 100, "b": 30, "c": 200}, 150, seed)
        assert sum(q.values()) == 150 and q["b"] <= 30 and max(q.values()) >= 2 * max(min(q.values()), 1)
    with pytest.raises(ValueError):
        sampling.skewed_quotas({"a": 10, "b": 10}, 20, 1)


def test_novelty_rejects_what_cannot_be_compared(spark):
    from veilwork.operators import filters

    rows = [(1, "some new words", 1, "others entirely"), (2, "!!", 1, "??"), (3, "x", 1, "yy"), (4, "same words here", 1, "same words here"),
            (5, "fine text", 1, "!!"), (6, None, 1, "aa")]
    df = spark.createDataFrame(rows, "id long, text string, seed_id long, seed_text string")
    assert sorted(r.id for r in filters.novelty_filter(df).collect()) == [1, 5]


def test_merge_of_files_with_equal_names(spark, tmp_path):
    from veilwork.sources import readers

    for folder, text in (("a", '{"instruction": "i1", "response": "r1"}\n\n{"instruction": "i2"}\n'), ("b", ' [{"instruction": "i3", "response": "r3"}]\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.json").write_text(text)
    (tmp_path / "b" / "other.json").write_text('{"instruction": "i4"}')
    got = readers.merge_by_file_name(spark, str(tmp_path)).select("file_name", "instruction", "response").collect()
    assert sorted(map(tuple, got), key=str) == [
        ("other.json", "i4", None), ("part.json", "i1", "r1"), ("part.json", "i2", None), ("part.json", "i3", "r3")]


def test_fusion_round_by_its_parts(spark, sf):
    from veilwork.cases._case import scores, split_embeddings
    from veilwork.plans import rounds

    private, cand = split_embeddings(spark, sf)
    out = {k: v.toPandas() for k, v in rounds.fusion_round(private, cand, scores(spark, sf), 600, 3, 0.0, "s").items()}
    p, c = private.toPandas(), cand.toPandas()
    for far, name in ((False, "near"), (True, "far")):
        votes = dict.fromkeys(c.id, 0.0)
        for r in p.itertuples():
            own = c[c.label == r.label]
            d = [(np.linalg.norm(np.array(r.embedding, float) - np.array(e, float)), i) for e, i in zip(own.embedding, own.id)]
            for k, (_, i) in enumerate(sorted(d, key=lambda x: (-x[0] if far else x[0], x[1]))[:3]):
                votes[i] += 2.0**-k
        want = {i for _, g in c.groupby("label") for i in sorted(g.id, key=lambda i: (-votes[i], i))[:3]}
        assert set(out[name].cand_id) == want
        if not far:
            share = {m: sum(votes[i] for i in g.id) / sum(votes.values()) * len(c) / len(g) for m, g in c.groupby("source_model")}
            e = {m: np.exp(x) for m, x in share.items()}
            exact = {m: 600 * x / sum(e.values()) for m, x in e.items()}
            assert sum(out["quota"].quota) == 600 and all(abs(q - exact[m]) < 1 for m, q in zip(out["quota"].source_model, out["quota"].quota))
    assert set(out["pool"].kind) == {"easy", "ambiguous"} and (out["pool"].groupby(["source_model", "kind"]).size() <= 60).all()


def test_class_feedback_gives_each_class_its_quota(spark, sf):
    from veilwork.cases._case import split_embeddings
    from veilwork.plans import rounds

    private, cand = split_embeddings(spark, sf)
    got, c = rounds.class_feedback_round(private, cand, 3, 5.0, 2.0, "s").toPandas(), cand.toPandas()
    assert (got.groupby("label").size() == 3).all() and not got.id.duplicated().any()
    assert set(zip(got.id, got.label)) <= set(zip(c.id, c.label)) and set(got["round"]) == {0, 1, 2}


@pytest.mark.parametrize("block", [40, 7])
def test_blocks_of_candidates_give_the_same_as_one(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3 if i % 10 else None, rng.normal(size=4).tolist() if i % 17 else None) for i in range(60)]
    p, c = vectors(spark, rows[:35]), vectors(spark, rows[25:])
    for rule in ("all", "same", "other"):
        one, many = (j.knn(p, c, 2, rule, block=b).select("id", "cand_id", "rank").collect() for b in (j.BLOCK, block))
        assert one and set(one) == set(many) and len(one) == len(many)
    for operator, columns in ((j.mean_cross_distance, ("mean_l2", "mean_cosine")), (j.mean_pair_psnr, ("psnr",))):
        one, many = ({r.label: r for r in operator(p, c, block=b).collect()} for b in (j.BLOCK, block))
        assert set(one) == set(many) and len(one) >= 3
        assert all(one[k][x] == pytest.approx(many[k][x]) for k in one if k is not None for x in columns)
    x, y = ([(r[1], np.array(r[2], np.float32).astype(float)) for r in part if r[1] is not None and r[2]] for part in (rows[:35], rows[25:]))
    score = lambda m: min(-10 * math.log10(m), 100.0) if m > 0 else 100.0
    for label, psnr in j.mean_pair_psnr(p, c, block=block).collect():
        assert psnr == pytest.approx(np.mean([score(((e - g) ** 2).sum() / 4 / 3) for k, e in x for n, g in y if k == n == label]))
    assert j.knn(p, c.limit(0), block=block).count() == 0 and j.knn(p.limit(0), c, block=block).count() == 0


def test_class_ranks_and_first_rows_match_a_window(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 3 > 0], float(i * 37 % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, x double").repartition(6)
    want = s.ranked(df, [F.col("x").desc(), F.col("id")], "label").collect()
    got = s.class_ranks(df, [F.col("x").desc(), F.col("id")], "label").select(*df.columns, "rank").collect()
    assert set(got) == set(want) and len(got) == len(want)
    order = [F.col("x"), F.col("id")]
    few, many = s.first_rows(df, order, 150), s.first_rows(df, order, 150, few=10)
    assert set(few.collect()) == set(many.collect()) and many.count() == 150
    assert s.first_rows(df.limit(0), order, 150, few=10).count() == 0 and s.class_ranks(df.limit(0), order, "label").count() == 0


def test_a_class_of_most_rows_is_picked_from_by_combined_aggregates(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise("big").alias("label"), F.when(F.col("id") % 7 > 0, F.col("id") % 13).cast("double").alias("score"))
    picked = m.exponential_pick(df, 5.0, 2.0, "s")
    want = {}
    for r in df.withColumn("g", keyed.gumbel("s", F.col("id"))).collect():
        u = 0.0 if r.score is None else math.exp(2.0 * (r.score / 12 - 1))
        want.setdefault(r.label, []).append((-(u * 2.5 / 2 + r.g), r.id))
    assert {r.label: r.id for r in picked.collect()} == {k: min(x)[1] for k, x in want.items()} and picked.columns == df.columns
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
    spans = s.interleave(df.select("id", "label"), "label", "id").collect()
    assert len(spans) == 800 and {(r.label, r.id) for r in spans if r.turn == 2} == {("small", 10), ("big", 2)}
